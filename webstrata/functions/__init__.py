"""Column functions: pure row-at-a-time transforms on built-in expressions."""
