"""Code-knowledge analytics on Spark DataFrames."""
