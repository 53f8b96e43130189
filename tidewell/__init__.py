"""Listing collection, cleaning and analytics on Spark DataFrames."""
