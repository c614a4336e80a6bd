"""webstrata: web-content analytics on Spark DataFrames."""
