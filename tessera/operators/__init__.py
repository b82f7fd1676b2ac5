"""Operators on DataFrames, and the registered queries that apply them."""
