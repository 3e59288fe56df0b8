"""Tables dealt and sorted by their keys once, when they are written, so that joins on the keys need no shuffle.

A table that is joined again and again (labels, training flags, parameters of runs) is worth its one shuffle at write time. Two
tables join without an exchange if they have the same number of buckets by the same keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from learntrace.session import ensure_checkpoint_dir

BUCKETS = 32


def write_bucketed(rows: DataFrame, keys: list[str], name: str | None = None, buckets: int = BUCKETS, folder: str | None = None) -> str:
    """Writes ``rows`` as a table in buckets by ``keys``, sorted within them, and returns its name.

    Rows are dealt by the keys first, so that a bucket is one file and its order survives. A key's rows are one bucket."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    folder = folder or f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/{name}"
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).mode("overwrite").saveAsTable(name)
    return name


def joined_in_buckets(spark: SparkSession, left: str, right: str, keys: list[str], how: str = "inner") -> DataFrame:
    """Two bucketed tables joined on their keys; a plan that would shuffle either is a ValueError."""
    found = spark.table(left).join(spark.table(right).hint("merge"), keys, how)
    if "Exchange" in found._jdf.queryExecution().executedPlan().toString():
        raise ValueError(f"{left} and {right} are not in the same buckets by {keys}")
    return found
