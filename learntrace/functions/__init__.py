"""Column functions on logit, probability and feature arrays."""
