"""Bitext analytics on Spark DataFrames."""
