"""tideline: study-level risk-indicator analytics on Spark DataFrames."""
