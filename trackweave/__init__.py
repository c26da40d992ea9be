"""Track-centric analytics on Spark DataFrames."""
