"""Exact dynamic-programming analytics on Spark DataFrames."""
