"""Analytics over recorded model traffic, and training-data preparation, on Spark DataFrames."""
