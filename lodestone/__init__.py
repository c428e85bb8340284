"""Lodestone: code and document retrieval, and corpus preparation, on Spark DataFrames."""
