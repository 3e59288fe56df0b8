"""Named columns and keyed rows: applying functions, batching, orders, set checks and expectations."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrace.operators.layers import distinct_layers, match_key
from learntrace.operators.ranking import order_position, positioned


def apply_all(df: DataFrame, columns: list[str], f: Callable[[Column], Column], prefix: str | None = None) -> DataFrame:
    """``f`` of each named column, renamed to ``{prefix}_{name}``; other columns stay."""
    shaped = [f(F.col(c)).alias(f"{prefix}_{c}" if prefix else c) for c in columns]
    return df.select(*[c for c in df.columns if c not in columns], *shaped)


def split_batches(rows: DataFrame, keys: list[str], item: str, size: int) -> DataFrame:
    """``rows`` with ``batch``: consecutive items by their order, ``size`` a batch, the last one shorter."""
    placed = order_position(rows, keys, item, item, "_lt_at")
    return placed.withColumn("batch", F.floor(F.col("_lt_at") / size).cast("long")).drop("_lt_at")


def select_checkpoint(rows: DataFrame, **where: str | int) -> DataFrame:
    """Rows of one checkpoint; on a table stored by these columns Spark reads their folders alone."""
    for name, value in where.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def order_known(rows: DataFrame, known: list[tuple[str, str]], column: str) -> DataFrame:
    """Rows whose value is known, with its display name and place in the given order."""
    table = rows.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(known)], f"{column} string, name string, place int")
    return rows.join(F.broadcast(table), column)  # the list is a literal of the caller's


def order_metrics(rows: DataFrame, column: str = "metric") -> DataFrame:
    return rows.select(column).distinct().orderBy(F.desc(column))


def zero_diagonal(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    return pairs.withColumn(value, F.when(F.col(a) == F.col(b), F.lit(0.0)).otherwise(F.col(value)))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether both tables have the same set of keys."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def disjoint_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    return a.select(*keys).intersect(b.select(*keys)).isEmpty()


def key_overlaps(rows: DataFrame, by: list[str], run: str, keys: list[str]) -> DataFrame:
    """For each two runs (of one group ``by``): ``n_both``, the keys in both, ``same`` and ``disjoint``, whether they have the
    same keys or none in common. Each key's set of runs is counted once, so the pairs come from as many rows as there are
    sets of runs."""
    sets = rows.groupBy(*by, *keys).agg(F.sort_array(F.collect_set(run)).alias("_runs")).groupBy(*by, "_runs").agg(F.count("*").alias("_n"))
    every = sets.groupBy(*by).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("_runs")))).alias("_all"))  # runs: tens
    paired = sets.join(every, by).withColumn("a", F.explode("_all")).withColumn("b", F.explode("_all")).where("a < b")
    has = lambda c: F.array_contains("_runs", F.col(c))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    both, either = n(has("a") & has("b")), n(has("a") | has("b"))
    return paired.groupBy(*by, F.col("a").alias("run_a"), F.col("b").alias("run_b")).agg(both.alias("n_both"), (both == either).alias("same"), (both == 0).alias("disjoint"))


def append_rows(parts: list[DataFrame], most: int | None = None, order: str | None = None) -> DataFrame:
    """All parts one after another; with ``most``, the rows of smallest ``order``, and a warning if there are fewer."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if most is None:
        return out
    n = out.count()
    if n < most:
        warnings.warn(f"{n} rows where {most} were expected", stacklevel=2)
    return out if n <= most else positioned(out, [], [order], "_lt_at").where(F.col("_lt_at") < most).drop("_lt_at")


def random_inputs(spark: SparkSession, n: int, dims: int, seed: int = 0) -> DataFrame:
    """example_id and x: normal test inputs."""
    return spark.range(n).select(F.col("id").alias("example_id"), F.array(*[F.randn(seed + i) for i in range(dims)]).alias("x"))


def find_layers(scorer: Callable[[DataFrame], DataFrame], spark: SparkSession, dims: int, n: int = 100, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Names of a model's distinct layers on random inputs, in order. ``scorer`` takes (example_id, x) and returns
    activations; two runs that differ are a ValueError."""
    rows = random_inputs(spark, n, dims)
    first, again = (scorer(rows).where(match_key(F.col("layer"), include, exclude)) for _ in range(2))
    found = [[(r["layer"], r["n"]) for r in distinct_layers(x).orderBy("layer_idx").collect()] for x in (first, again)]  # layers: tens
    off = first.select("layer_idx", "example_id", F.col("act").alias("a")).join(again.select("layer_idx", "example_id", F.col("act").alias("b")), ["layer_idx", "example_id"])
    if found[0] != found[1] or not off.where(F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x - y) > 1e-6), lambda d: d)).isEmpty():
        raise ValueError("two runs over the same inputs differ")
    return [name for name, _ in found[0]]


def accumulate_batches(rows: DataFrame, batch: str, item: str, order: str, value: str) -> DataFrame:
    """item, n and mean over minibatches that each hold a subset of the items: an item counts once a batch,
    with its last value there."""
    once = rows.groupBy(batch, item).agg(F.max(F.struct(order, value)).alias("_l")).select(item, F.col(f"_l.{value}").alias(value))
    return once.groupBy(item).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def running_total(rows: DataFrame, keys: list[str], order: str, value: str, out: str = "total") -> DataFrame:
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
