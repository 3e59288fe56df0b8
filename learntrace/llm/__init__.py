"""Operators of a training-data pipeline: each module takes a DataFrame and returns a DataFrame."""
