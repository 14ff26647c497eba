"""Exact vector search, study analytics and corpus preparation on Spark DataFrames."""
