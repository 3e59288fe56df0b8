"""All scores of each row of a logit table in one narrow projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.functions import pointwise as fn

METRICS = ("acc", "ent", "conf", "maxconf", "margin", "el2n")


def pointwise_metrics(logits: DataFrame, z: str = "z", label: str = "label", loss: bool = False) -> DataFrame:
    """``logits`` without ``z``, with acc, ent, conf, maxconf, margin and el2n (and loss).

    The softmax is computed once a row and shared through a struct; nothing is shuffled."""
    def scores(p: Column) -> Column:
        y = F.col(label)
        return F.struct(
            fn.zero_one_accuracy(F.col(z), y).alias("acc"), fn.entropy(p).alias("ent"), fn.class_confidence(p, y).alias("conf"), fn.max_confidence(p).alias("maxconf"),
            fn.margin(p, y).alias("margin"), fn.error_l2_norm(p, y).alias("el2n"),
        )

    keys = [c for c in logits.columns if c != z]
    df = logits.withColumn("_s", fn.once(fn.softmax(F.col(z)), scores))
    more = [fn.cross_entropy(F.col(z), F.col(label)).alias("loss")] if loss else []
    return df.select(*keys, *[F.col(f"_s.{m}").alias(m) for m in METRICS], *more)


def evaluate(examples: DataFrame, scorer: Callable[[DataFrame], DataFrame], accuracy: bool = True, loss: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Model evaluation as a scan: ``scorer`` adds ``z``; accuracy and a loss callback are optional columns."""
    df = scorer(examples)
    if accuracy:
        df = df.withColumn("acc", fn.zero_one_accuracy(F.col("z"), F.col("label")))
    return df if loss is None else df.withColumn("loss", loss(F.col("z"), F.col("label")))
