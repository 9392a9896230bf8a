"""Operators: each takes DataFrames or columns and returns them."""
