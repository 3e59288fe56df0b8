"""Scores and aggregates in the session catalogue, for use in SQL text.

Scores are SQL functions: their bodies become part of the plan that calls them, so nothing of them is opaque to the
optimiser and none runs in Python. Counts of edges depend on the order of steps and are aggregates over Arrow: one
trajectory at a time is in memory, which is as long as a training run has checkpoints.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

Z = "z ARRAY<DOUBLE>"
P = "p ARRAY<DOUBLE>"
#: Name: parameters, result, body.
SCORES = {
    "softmax": (Z, "ARRAY<DOUBLE>", "transform(z, x -> exp(x - array_max(z)) / aggregate(z, 0D, (a, v) -> a + exp(v - array_max(z))))"),
    "first_argmax": (Z, "INT", "CAST(array_position(z, array_max(z)) - 1 AS INT)"),
    "zero_one_accuracy": (f"{Z}, label INT", "BOOLEAN", "array_position(z, array_max(z)) - 1 = label"),
    "entropy": (P, "DOUBLE", "-aggregate(transform(p, x -> CASE WHEN x > 0 THEN x * ln(x) ELSE 0D END), 0D, (a, x) -> a + x)"),
    "class_confidence": (f"{P}, label INT", "DOUBLE", "get(p, label)"),
    "max_confidence": (P, "DOUBLE", "array_max(p)"),
    "margin": (f"{P}, label INT", "DOUBLE", "get(p, label) - array_max(transform(p, (x, i) -> CASE WHEN i = label THEN 0D ELSE x END))"),
    "error_l2_norm": (f"{P}, label INT", "DOUBLE", "sqrt(aggregate(transform(p, (x, i) -> pow(x - CASE WHEN i = label THEN 1D ELSE 0D END, 2)), 0D, (a, x) -> a + x))"),
    "cross_entropy": (f"{Z}, label INT", "DOUBLE", "ln(aggregate(transform(z, x -> exp(x - array_max(z))), 0D, (a, x) -> a + x)) + array_max(z) - get(z, label)"),
    "vector_norm": ("v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(transform(v, x -> x * x), 0D, (a, x) -> a + x))"),
}


def _ordered(step: pd.Series, acc: pd.Series) -> np.ndarray:
    return acc.to_numpy(dtype=bool)[np.argsort(step.to_numpy(), kind="stable")]


def count_forgetting(step: pd.Series, acc: pd.Series) -> int:
    """Times that a trajectory goes from right to wrong."""
    a = _ordered(step, acc)
    return int((a[:-1] & ~a[1:]).sum())


def first_learned(step: pd.Series, acc: pd.Series) -> int:
    """The first right step, the number of steps if there is none."""
    right = step[acc.to_numpy(dtype=bool)]
    return int(right.min()) if len(right) else len(step)


def unforgettable(step: pd.Series, acc: pd.Series) -> bool:
    a = _ordered(step, acc)
    return bool(a.any() and not (a[:-1] & ~a[1:]).any())


AGGREGATES = {"count_forgetting": (count_forgetting, "long"), "first_learned": (first_learned, "long"), "unforgettable": (unforgettable, "boolean")}


def register_functions(spark: SparkSession) -> list[str]:
    """Puts all functions into the session and returns their names; a name that the session has is replaced."""
    for name, (parameters, result, body) in SCORES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (fn, kind) in AGGREGATES.items():
        fn.__annotations__ = {"step": pd.Series, "acc": pd.Series, "return": bool if kind == "boolean" else int}
        spark.udf.register(name, F.pandas_udf(fn, kind))
    return sorted([*SCORES, *AGGREGATES])
