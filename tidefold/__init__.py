"""Sequential state estimation and tabular analytics on Spark DataFrames."""
