"""Checks that come from the pass that writes: counts, minima and violations without a job of their own."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def written(rows: DataFrame, folder: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``rows`` written as Parquet and read again, and the measures (aggregates) of the rows that the one job saw."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder), dict(seen.get)


def write_appended(parts: list[DataFrame], folder: str, expected: int | None = None) -> DataFrame:
    """All parts as one written table; a warning if they are fewer rows than expected. One job."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    table, seen = written(out, folder)
    if expected is not None and seen["n"] < expected:
        warnings.warn(f"{seen['n']} rows where {expected} were expected", stacklevel=2)
    return table


def write_checked_metrics(metrics: DataFrame, folder: str) -> tuple[DataFrame, dict]:
    """The long metric table written, with what its checks ask for: rows without a training flag, training rows, undefined
    values and the range of values. One job."""
    value = F.col("value")
    undefined = value.isNull() | F.isnan(value)
    return written(metrics, folder, unflagged=F.count_if(F.col("is_train").isNull()), n_train=F.count_if("is_train"), undefined=F.count_if(undefined), least=F.min(F.when(~undefined, value)), most=F.max(F.when(~undefined, value)))
