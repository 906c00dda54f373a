"""Field inspection and survey analytics on Spark DataFrames."""
