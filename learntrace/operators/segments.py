"""Mergeable summaries of trajectories whose steps come in any order.

A segment stands for a stretch of steps that follow one another without a gap: its first and last step, whether the example was right at
either end, the times it was forgotten inside, its first right and its last wrong step. Two segments that touch are one again, so
summaries of any parts of a trajectory merge, whatever the parts and their order, and an example's summary has as many
segments as its steps have gaps, one when all have come.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Table = dict[str, np.ndarray]  # segments of many examples, an array a field
FIELDS = {"example_id": int, "first": int, "last": int, "first_acc": bool, "last_acc": bool, "forgets": int, "first_right": int, "last_wrong": int}
NEVER = {"first_right": np.iinfo(np.int64).max, "last_wrong": np.iinfo(np.int64).min}  # stand for null in tables


def table(columns: Iterable[Sequence]) -> Table:
    """Segments from a sequence a field, in which null is None."""
    filled = {c: [NEVER[c] if v is None else v for v in x] if c in NEVER else x for c, x in zip(FIELDS, columns, strict=True)}
    return {c: np.array(x, dtype=FIELDS[c]) for c, x in filled.items()}


def lists(segments: Table) -> tuple[list, ...]:
    """A list a field, in which null is None."""
    return tuple([None if v == NEVER[c] else v for v in x.tolist()] if c in NEVER else x.tolist() for c, x in segments.items())


def of_steps(ids: np.ndarray, step: np.ndarray, acc: np.ndarray) -> Table:
    """A segment a step."""
    right, wrong = np.where(acc, step, NEVER["first_right"]), np.where(acc, NEVER["last_wrong"], step)
    return dict(zip(FIELDS, (ids, step, step, acc, acc, np.zeros(len(step), dtype=int), right, wrong), strict=True))


def joined(tables: Sequence[Table]) -> Table:
    return {c: np.concatenate([t[c] for t in tables]) for c in FIELDS}


def _follows(ids: np.ndarray) -> np.ndarray:
    """Whether the row before is of the same example."""
    return np.r_[False, ids[1:] == ids[:-1]][: len(ids)]


def merged(held: Table, new: Table, stride: int = 1) -> Table:
    """Segments of many examples in order, those that touch as one. A single step that another segment holds is a step that
    came again and changes nothing (of equal steps that held, then a wrong one, stays); longer segments that overlap are a ValueError."""
    rows = joined((held, new))
    came = np.arange(len(rows["first"])) >= len(held["first"])
    order = np.lexsort((rows["first_acc"], came, -rows["last"], rows["first"], rows["example_id"]))
    ids, first, last, first_acc, last_acc, forgets, right, wrong = (x[order] for x in rows.values())
    follows = _follows(ids)
    values, rank = np.unique(last, return_inverse=True)
    base = np.cumsum(~follows) * len(values)
    reached = values[np.maximum.accumulate(base + rank) - base]  # the greatest step of an example's segments so far
    again = follows & (first <= np.roll(reached, 1))
    twice = np.flatnonzero(again & (first != last))
    if len(twice):
        raise ValueError(f"steps {first[twice[0]]} to {min(last[twice[0]], reached[twice[0] - 1])} are in two summaries")
    ids, first, last, first_acc, last_acc, forgets, right, wrong = (x[~again] for x in (ids, first, last, first_acc, last_acc, forgets, right, wrong))
    touches = _follows(ids) & (first == np.roll(last, 1) + stride)
    starts = np.flatnonzero(~touches)
    ends = np.r_[starts[1:], len(ids)][: len(starts)] - 1
    inside = np.add.reduceat(forgets + (touches & np.roll(last_acc, 1) & ~first_acc), starts)
    columns = ids[starts], first[starts], last[ends], first_acc[starts], last_acc[ends], inside, np.minimum.reduceat(right, starts), np.maximum.reduceat(wrong, starts)
    return dict(zip(FIELDS, columns, strict=True))


def scores(segments: Table, start_at_zero: bool = True, stride: int = 1) -> Table:
    """n, countforget, unforgettable, firstlearn and firstunforgettable of each example's steps that are there, from segments in
    order; steps on both sides of a gap count as neighbours until the gap is filled."""
    ids, first, last, first_acc, last_acc, forgets, right, wrong = segments.values()
    follows = _follows(ids)
    starts = np.flatnonzero(~follows)
    before = np.where(follows, np.roll(last_acc, 1), not start_at_zero)
    n, forgot = np.add.reduceat((last - first) // stride + 1, starts), np.add.reduceat(forgets + (before & ~first_acc), starts)
    right, wrong = np.minimum.reduceat(right, starts), np.maximum.reduceat(wrong, starts)
    learnt, erred = right != NEVER["first_right"], wrong != NEVER["last_wrong"]
    ends = {"firstlearn": np.where(learnt, right, n), "firstunforgettable": np.where(erred, wrong + stride, 0)}
    return {"example_id": ids[starts], "n": n, "countforget": forgot, "unforgettable": (forgot == 0) & learnt, **ends}


def segments_of(trajectory: DataFrame, key: str = "example_id", stride: int = 1) -> DataFrame:
    """``key``, ``first`` and the other fields of every segment of (key, step, acc); of a step that comes twice the smaller acc counts."""
    rows = trajectory.groupBy(key, F.col("step").cast("long").alias("step")).agg(F.bool_and("acc").alias("acc"))
    island = F.col("step") - stride * F.row_number().over(Window.partitionBy(key).orderBy("step"))
    placed = rows.withColumn("_i", island).withColumn("_p", F.lag("acc", 1, False).over(Window.partitionBy(key, "_i").orderBy("step")))
    ends = (F.min("step").alias("first"), F.max("step").alias("last"), F.min(F.struct("step", "acc"))["acc"].alias("first_acc"), F.max(F.struct("step", "acc"))["acc"].alias("last_acc"))
    inside = (F.count_if(F.col("_p") & ~F.col("acc")).alias("forgets"), F.min(F.when(F.col("acc"), F.col("step"))).alias("first_right"), F.max(F.when(~F.col("acc"), F.col("step"))).alias("last_wrong"))
    return placed.groupBy(key, "_i").agg(*ends, *inside).drop("_i")
