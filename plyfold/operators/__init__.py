"""Operators on DataFrames: shapes, dictionary, templates, fragments, delta and repeat, guards."""
