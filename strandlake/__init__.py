"""Sequence analytics and corpus preparation expressed as Spark DataFrames."""
