"""Agreement of an ensemble of runs on each example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensemble_accuracy(acc: str = "acc") -> Column:
    return F.avg(F.col(acc).cast("int"))


def always_learned(acc: str = "acc") -> Column:
    return F.bool_and(acc)


def never_learned(acc: str = "acc") -> Column:
    return ~F.bool_or(acc)


def dichotomy(acc: str = "acc") -> Column:
    """1 if every run is right, -1 if none is, else 0."""
    return F.when(F.bool_and(acc), 1).when(~F.bool_or(acc), -1).otherwise(0)


def consensus_labels(votes: DataFrame, keys: list[str], pred: str = "pred") -> DataFrame:
    """The label with the most votes, the smallest of those that tie.

    Votes are counted first, so a window sees a row a class and not a row a run."""
    counted = votes.groupBy(*keys, pred).agg(F.count("*").alias("n_votes"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n_votes"), pred)
    return counted.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, F.col(pred).alias("consensuslabel"), "n_votes")


def ensemble_metrics(votes: DataFrame, keys: list[str], acc: str = "acc", pred: str = "pred") -> DataFrame:
    """ddd, allacc and consensuslabel by one shuffle: a histogram of votes is an aggregate too."""
    slots = votes.groupBy(*keys, pred).agg(F.count("*").alias("n"), F.sum(F.col(acc).cast("int")).alias("right"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(pred).alias("pred")))["pred"]
    right, n = F.sum("right"), F.sum("n")
    return slots.groupBy(*keys).agg(F.when(right == n, 1).when(right == 0, -1).otherwise(0).alias("ddd"), (right / n).alias("allacc"), best.alias("consensuslabel"))
