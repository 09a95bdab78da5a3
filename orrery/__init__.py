"""Market rotation analytics on Spark DataFrames."""
