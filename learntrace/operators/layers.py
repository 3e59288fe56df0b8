"""Selecting and deduplicating hidden layers of a long activation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_key(name: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether any ``include`` pattern occurs (or none is given) and no ``exclude`` pattern does."""
    has = lambda patterns: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(name, p))
    kept = has(include) if include else F.lit(True)
    return kept & ~has(exclude) if exclude else kept


def module_name(layer: Column) -> Column:
    return F.regexp_replace(layer, r"\.(in|out)$", "")


def select_layers(activations: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, layers: list[str] | None = None) -> DataFrame:
    """Rows of the layers that the patterns choose, or, whatever the patterns, of the named ones."""
    return activations.where(F.col("layer").isin(layers) if layers is not None else match_key(F.col("layer"), include, exclude))


def layer_digests(activations: DataFrame, act: str = "act") -> DataFrame:
    """An order-free 128-bit digest of each layer: two sums of row hashes, so it aggregates partially."""
    row = lambda seed: F.xxhash64(F.lit(seed), "example_id", act).cast("decimal(38,0)")
    return activations.groupBy("layer_idx", "layer").agg(F.count("*").alias("n"), F.sum(row(1)).alias("d1"), F.sum(row(2)).alias("d2"))


def distinct_layers(activations: DataFrame, act: str = "act") -> DataFrame:
    """Layers whose values equal no earlier layer's. Digests propose the earlier layer; values are compared after."""
    first = Window.partitionBy("n", "d1", "d2").orderBy("layer_idx")  # over layers: tens
    told = layer_digests(activations, act).withColumn("_first", F.first("layer_idx").over(first))
    twins = told.where("layer_idx <> _first").select("layer_idx", "_first")
    one = activations.join(F.broadcast(twins), "layer_idx").select("layer_idx", F.col("_first").alias("_f"), "example_id", F.col(act).alias("_a"))
    two = activations.select(F.col("layer_idx").alias("_f"), "example_id", F.col(act).alias("_b"))
    differ = one.join(two, ["_f", "example_id"]).where(~F.col("_a").eqNullSafe(F.col("_b"))).select("layer_idx").distinct()
    same = twins.select("layer_idx").join(differ, "layer_idx", "left_anti")
    return told.join(same, "layer_idx", "left_anti").select("layer_idx", "layer", "n")


def append_layer(activations: DataFrame, values: DataFrame, layer: str) -> DataFrame:
    """``activations`` and one more layer after the last, such as the softmax of the outputs."""
    last = activations.agg((F.max("layer_idx") + 1).alias("layer_idx"))
    return activations.unionByName(values.crossJoin(F.broadcast(last)).withColumn("layer", F.lit(layer)).select(*activations.columns))
