"""Catalog search and corpus preparation on Spark DataFrames."""
