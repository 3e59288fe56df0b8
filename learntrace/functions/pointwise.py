"""Scores of one example from its logits ``z`` or probabilities ``p`` and its 0-based label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learntrace.functions.vectors import argmax, l2_norm, once, total


def softmax(z: Column) -> Column:
    """Probabilities; the maximum is taken off first, so large logits stay finite."""
    return once(z, lambda v: once(F.array_max(v), lambda top: once(F.transform(v, lambda x: F.exp(x - top)), lambda e: once(total(e), lambda s: F.transform(e, lambda x: x / s)))))


def zero_one_accuracy(z: Column, label: Column) -> Column:
    return argmax(z) == label


def entropy(p: Column) -> Column:
    """In nats; a probability of 0 adds nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def class_confidence(p: Column, label: Column) -> Column:
    return F.get(p, label)


def max_confidence(p: Column) -> Column:
    return F.array_max(p)


def margin(p: Column, label: Column) -> Column:
    """Confidence in the label less the largest other probability (0 with one class)."""
    return F.get(p, label) - F.array_max(F.transform(p, lambda x, i: F.when(i == label, 0.0).otherwise(x)))


def error_l2_norm(p: Column, label: Column) -> Column:
    return l2_norm(F.transform(p, lambda x, i: x - F.when(i == label, 1.0).otherwise(0.0)))


def cross_entropy(z: Column, label: Column) -> Column:
    return once(F.array_max(z), lambda top: F.ln(total(F.transform(z, lambda x: F.exp(x - top)))) + top) - F.get(z, label)


def softmax_class_confidence(z: Column, label: Column) -> Column:
    return class_confidence(softmax(z), label)
