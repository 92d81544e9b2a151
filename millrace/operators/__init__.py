"""Relational operators, data changes and integrity checks, each a function from DataFrames to a DataFrame."""
