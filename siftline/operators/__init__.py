"""Operators on DataFrames; each module covers one family."""
