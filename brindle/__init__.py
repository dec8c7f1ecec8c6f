"""Sparse entity-by-feature analytics on Spark DataFrames."""
