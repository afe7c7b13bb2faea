"""Contract validation and drift analytics on Spark DataFrames."""
