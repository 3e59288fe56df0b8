"""Metrics of many runs in one long table (model, replicate, metric, example_id, value, is_train)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_replicates(metrics: DataFrame, *, model: str, metric: str) -> DataFrame:
    return metrics.where((F.col("model") == model) & (F.col("metric") == metric))


def restrict_to_runs(metrics: DataFrame, runs: DataFrame, on: list[str]) -> DataFrame:
    return metrics.join(runs.select(*on).distinct(), on, "left_semi")


def runs_of(hparams: DataFrame, model_name: str) -> DataFrame:
    """Runs of a model that were trained on their own split: ``run`` is the stem of the path."""
    kept = hparams.where((F.col("model_name") == model_name) & F.col("custom_train_test_split"))
    return kept.withColumn("run", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))


def reductions(value: str = "value", is_train: str = "is_train") -> list[Column]:
    """Mean and median over all replicates, those that trained on the example, and the others."""
    parts = {"all": F.lit(True), "train": F.col(is_train), "test": ~F.col(is_train)}
    return [f(F.when(c, F.col(value))).alias(f"{name}_{r}") for name, c in parts.items() for r, f in (("mean", F.avg), ("median", F.median))]


def combine_metrics(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every reduction of every metric and example by one shuffle."""
    return metrics.groupBy(*(keys or ["model", "metric", "example_id"])).agg(*reductions())


def export_wide(combined: DataFrame, metrics: list[str], columns: list[str]) -> DataFrame:
    """One row an example and one column ``{column}.{metric}`` a reduction and metric, for export."""
    wide = combined.groupBy("example_id").pivot("metric", metrics).agg(*[F.first(c).alias(c) for c in columns])
    return wide.select("example_id", *[F.col(f"`{m}_{c}`").alias(f"{c}.{m}") for m in metrics for c in columns])


def train_violations(metrics: DataFrame) -> DataFrame:
    """Keys whose mean of ``is_train`` is not 1 over training or not 0 over test replicates: none."""
    flag = F.col("is_train").cast("int")
    per = metrics.groupBy("model", "metric", "example_id").agg(F.avg(F.when(F.col("is_train"), flag)).alias("train"), F.avg(F.when(~F.col("is_train"), flag)).alias("test"))
    return per.where((F.coalesce("train", F.lit(1.0)) != 1) | (F.coalesce("test", F.lit(0.0)) != 0))


def train_counts(metrics: DataFrame) -> DataFrame:
    """Least, mean and most training replicates of an example, by model and metric."""
    per = metrics.groupBy("model", "metric", "example_id").agg(F.count_if("is_train").alias("n"))
    return per.groupBy("model", "metric").agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def average_over_replicates(metrics: DataFrame, names: list[str], model: str | None = None, median: bool = False) -> DataFrame:
    """A row a model (or of the named one) and example, a column a metric."""
    f = F.median if median else F.avg
    rows = metrics if model is None else metrics.where(F.col("model") == model)
    return rows.groupBy("model", "example_id").pivot("metric", names).agg(f("value"))


def outer_union(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All rows of both tables; where both have a key, the first one's values that are not null win."""
    right = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return a.join(right, keys, "full").select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])
