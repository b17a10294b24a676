"""Document and reading analytics on Spark DataFrames."""
