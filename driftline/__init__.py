"""Movement and proximity analytics on Spark DataFrames."""
