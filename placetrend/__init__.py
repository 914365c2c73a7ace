"""Locality trend analytics on Spark DataFrames."""
