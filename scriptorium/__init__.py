"""Document-knowledge analytics on Spark DataFrames."""
