"""Incremental versions of the trajectory scores on Structured Streaming."""
