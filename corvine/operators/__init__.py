"""Operators: small functions from DataFrames to DataFrames."""
