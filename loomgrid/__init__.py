"""Panel and training-data analytics on Spark DataFrames."""
