"""Ranks, orders and equal-width rank bins over whole columns, without a window over all of a group.

Rows are dealt by ranges of (keys, value, tie) and sorted where they lie, so a task holds a range of the order
whatever the groups and however many rows share a value. A row's place is its place in its range and the number of
the group's rows in the ranges before, which are counted: a number for each range and group that it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learntrace.session import cut

_INDEX_BITS = 33  # of monotonically_increasing_id, below which stands a row's place in its partition
BROADCAST_OFFSETS = 200_000


def _with_offsets(dealt: DataFrame, keys: list[str], size: Column, start: Column) -> DataFrame:
    """``dealt`` (with ``_range``) and ``_before``: what ``size`` sums to in the group's ranges before, less ``start``."""
    counts = dealt.groupBy(*keys, "_range").agg(size.alias("_n"), start.alias("_start"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ranges of a group: at most the partitions
    own = [*keys, "_range"]
    offsets = counts.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(own)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).alias("_before"))
    offsets = F.broadcast(offsets) if counts.count() <= BROADCAST_OFFSETS else offsets
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(own)))
    return dealt.join(offsets, same).select(*dealt.columns, "_before")


def positioned(rows: DataFrame, keys: list[str], order: list[str], out: str = "position") -> DataFrame:
    """``rows`` with their 0-based place in the order of the columns ``order`` within the keys."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    dealt = cut(dealt.withColumns({"_range": F.spark_partition_id(), "_index": index}))
    placed = _with_offsets(dealt, keys, F.count("*"), F.min("_index"))
    return placed.select(*rows.columns, (F.col("_index") + F.col("_before")).cast("long").alias(out))


def value_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row for each key and distinct value: ``n`` and ``below``, the number of smaller values. Equal values are
    counted before they are dealt, so a value that a third of all rows share is one row."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = cut(distinct.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_offsets(dealt, keys, F.sum("n"), F.lit(0)).withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.select(*keys, value, "n", (F.col("_before") + F.col("_in")).alias("below"))


def rank_average(rows: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """``rows`` with 0-based ranks, the mean rank where values tie; null values have no rank, null keys are keys."""
    ranks = value_ranks(rows, keys, value).withColumn(out, F.col("below") + (F.col("n") - 1) / F.lit(2.0))
    ranks = ranks.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate([*keys, value])], out)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate([*keys, value])))
    return rows.join(ranks, same, "left").select(*rows.columns, out)


def order_position(rows: DataFrame, keys: list[str], value: str, tie: str, out: str = "position") -> DataFrame:
    """``rows`` with their 0-based place in the order of (value, tie) within the keys."""
    return positioned(rows, keys, [value] if value == tie else [value, tie], out)


def argsort(rows: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """Long form of an order array: ``rank`` and the item that holds it."""
    return order_position(rows, keys, value, item, "rank").select(*keys, "rank", item)


def order_to_rank(orders: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The inverse permutation of an order array: a row an item with its rank."""
    return orders.select(*keys, F.posexplode(order).alias("rank", "example_id"))


def rank_bins(rows: DataFrame, keys: list[str], value: str, tie: str, bins: int = 100) -> DataFrame:
    """``rows`` with ``bin``: places spread evenly over 0 to bins - 1; the last bin holds the top row alone."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = order_position(rows, keys, value, tie, "_at").join(sizes, keys)
    at = F.when(F.col("_n") > 1, F.floor(F.col("_at") * (bins - 1) / (F.col("_n") - 1))).otherwise(0)
    return placed.select(*rows.columns, at.cast("int").alias("bin"))


def quantiles(rows: DataFrame, keys: list[str], value: str, tie: list[str], shares: dict[str, float]) -> DataFrame:
    """A row a key, ``n``, ``mean`` and a column a share: the exact quantile, interpolated between the two rows that it lies
    between. Nulls count in ``n`` alone.

    Rows are placed once, not gathered: a group of any size aggregates partially."""
    placed = positioned(rows.select(*keys, value, *tie), keys, [value, *tie], "_at")  # nulls come first
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.count(value).alias("_n"))
    named = sizes.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(keys)], "n", "mean", "_n")
    placed = placed.join(named, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(keys))))

    def at(share: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(share)
        before = F.col("n") - F.col("_n")
        pick = lambda place: F.max(F.when(F.col("_at") == before + place, F.col(value)))
        low, high = pick(F.floor(h)), pick(F.ceil(h))
        return low + (high - low) * F.max(h - F.floor(h))

    return placed.groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *[at(s).alias(n) for n, s in shares.items()])


def binned_quantiles(rows: DataFrame, bins: DataFrame, keys: list[str], item: str, value: str, shares: tuple[float, float] = (0.05, 0.95), tie: str | None = None, flags: Column | None = None) -> DataFrame:
    """For each bin of items: the mean, median and quantiles of all their values, and ``x``, the number
    of values up to and with the bin. Values of a column of flags (a condition on the keys) have no low and high."""
    joined = rows.join(bins.select(*keys, item, "bin"), [*keys, item])
    per = quantiles(joined, [*keys, "bin"], value, [item, *([tie] if tie else [])], {"median": 0.5, "low": shares[0], "high": shares[1]})
    if flags is not None:
        per = per.withColumns({c: F.when(~flags, F.col(c)) for c in ("low", "high")})
    return per.withColumn("x", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")))  # bins of a key: a hundred
