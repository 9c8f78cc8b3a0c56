"""Versioned key-value analytics on Spark DataFrames."""
