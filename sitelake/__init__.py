"""Position-level annotation analytics on Spark DataFrames."""
