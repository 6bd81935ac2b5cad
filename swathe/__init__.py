"""Gridded survey analytics on Spark DataFrames."""
