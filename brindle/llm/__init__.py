"""Operators of a training-data pipeline: filtering, deduplication, mixing, tokenising, search.

Every operator is a function from DataFrames to a DataFrame.  Nothing outside this subpackage imports it.
"""
