"""Learning and forgetting events of 0/1 trajectories over dense 0-based steps.

First and last events need no ordering: they are minima and maxima of steps, so they aggregate
partially before the shuffle. Only counts of edges look at the step before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(trajectory: DataFrame, keys: list[str], start: bool, step: str = "step", acc: str = "acc") -> DataFrame:
    """``trajectory`` with ``learned`` and ``forgot``: rising and falling edges from a virtual ``start``."""
    before = F.lag(acc, 1, start).over(Window.partitionBy(*keys).orderBy(step))
    return trajectory.withColumns({"learned": ~before & F.col(acc), "forgot": before & ~F.col(acc)})


def first_event(event: Column, step: str = "step") -> Column:
    """Step of the first event, the number of steps if there is none."""
    return F.coalesce(F.min(F.when(event, F.col(step))), F.count("*"))


def last_event(event: Column, step: str = "step") -> Column:
    return F.coalesce(F.max(F.when(event, F.col(step))), F.count("*"))


def first_learn(acc: str = "acc", step: str = "step") -> Column:
    return first_event(F.col(acc), step)


def first_forget(acc: str = "acc", step: str = "step") -> Column:
    return first_event(~F.col(acc), step)


def first_unforgettable(acc: str = "acc", step: str = "step") -> Column:
    """The step from which on the example is always right; the number of steps if it ends wrong."""
    return F.coalesce(F.max(F.when(~F.col(acc), F.col(step))) + 1, F.lit(0)).cast("long")


def first_unlearnable(acc: str = "acc", step: str = "step") -> Column:
    """The step from which on the example is always wrong."""
    return F.coalesce(F.max(F.when(F.col(acc), F.col(step))) + 1, F.lit(0)).cast("long")


def forget_metrics(trajectory: DataFrame, keys: list[str], start_at_zero: bool = True, step: str = "step", acc: str = "acc") -> DataFrame:
    """countforget and unforgettable, and firstlearn with firstunforgettable (from 0) or firstforget
    with firstunlearnable (from 1): one window, one aggregation, both over the same partitioning."""
    marked = edges(trajectory, keys, not start_at_zero, step, acc)
    n = F.count_if("forgot")
    ends = {"firstlearn": first_learn(acc, step), "firstunforgettable": first_unforgettable(acc, step)} if start_at_zero else {"firstforget": first_forget(acc, step), "firstunlearnable": first_unlearnable(acc, step)}
    return marked.groupBy(*keys).agg(n.alias("countforget"), ((n == 0) & F.bool_or(acc)).alias("unforgettable"), *[c.cast("long").alias(k) for k, c in ends.items()])
