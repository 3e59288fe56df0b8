"""Statistics over steps or runs, and their mergeable states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def average_metrics(rows: DataFrame, keys: list[str], metrics: list[str], prefix: str = "avg") -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(F.col(m).cast("double")).alias(f"{prefix}_{m}") for m in metrics])


def variance_metrics(rows: DataFrame, keys: list[str], metrics: list[str], prefix: str = "var") -> DataFrame:
    """Unbiased variance; null for a single row."""
    return rows.groupBy(*keys).agg(*[F.var_samp(F.col(m).cast("double")).alias(f"{prefix}_{m}") for m in metrics])


def online_pointwise(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and variance of every metric from one pass."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[f(F.col(m).cast("double")).alias(f"{p}_{m}") for m in metrics for p, f in (("avg", F.avg), ("var", F.var_samp))])


def last_metrics(rows: DataFrame, keys: list[str], metrics: list[str], step: str = "step", prefix: str = "last") -> DataFrame:
    """The metrics of each key's last step; all of one row even where steps tie."""
    last = F.max(F.struct(F.col(step), *metrics))
    return rows.groupBy(*keys).agg(last.alias("_l")).select(*keys, *[F.col(f"_l.{m}").alias(f"{prefix}_{m}") for m in metrics])


def stack_metrics(steps: dict[int, DataFrame], step: str = "step") -> DataFrame:
    """Frames of single steps as one long frame."""
    return reduce(DataFrame.unionByName, [df.withColumn(step, F.lit(s)) for s, df in steps.items()])


def moment_state(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """State n, mean, m2 (sum of squared deviations) of each key."""
    x = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merge_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merges any number of states of a key.

    m2 of the union is the sum of the parts' m2 and of n (mean - common mean)^2; the common mean is a
    window over the parts, of which there are few."""
    states = states.where("n > 0")
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    parts = F.collect_list(F.struct("n", "mean", "m2"))
    merged = states.groupBy(*keys).agg(n.alias("n"), (s / n).alias("mean"), parts.alias("_p"))
    m2: Column = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return merged.select(*keys, "n", "mean", m2.alias("m2"))


def finish_moments(states: DataFrame) -> DataFrame:
    """``states`` with ``variance``, null below two rows."""
    return states.withColumn("variance", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)))


def standardize(rows: DataFrame, keys: list[str], value: str, out: str = "scaled") -> DataFrame:
    """(x - mean) / population deviation within each key; 0 where all values are equal.

    Two moments of each key come from a partial aggregation and are joined back, so that no task
    holds a key's rows; the moments are as many as the keys."""
    moments = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    scaled = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(F.col(value) - F.col("_mean"))
    return rows.join(moments, keys).withColumn(out, scaled).drop("_mean", "_sd")
