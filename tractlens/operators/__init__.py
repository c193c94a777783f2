"""Operators. Each one is a function from DataFrames to a DataFrame."""
