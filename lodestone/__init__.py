"""Indexed code and text search on Spark DataFrames."""
