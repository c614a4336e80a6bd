"""Named queries and their SQL, composed from functions and operators."""
