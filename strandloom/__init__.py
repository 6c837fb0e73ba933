"""Ordered-sequence and frame analytics expressed as Spark DataFrames."""
