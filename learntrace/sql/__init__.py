"""Scores, events and batches under names that SQL text can use."""
