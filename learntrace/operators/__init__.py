"""Operators on whole tables: each takes DataFrames with named keys and returns a DataFrame."""
