"""Process-event analytics on Spark DataFrames."""
