"""Search, ranking and vector analytics on DataFrames."""
