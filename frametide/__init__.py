"""Frame-stamped event and motion analytics on Spark DataFrames."""
