"""Revision-drift analytics on Spark DataFrames."""
