"""Bulk claim verification and text-corpus processing on Spark DataFrames."""
