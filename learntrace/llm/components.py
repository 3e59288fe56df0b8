"""Connected components of a link table by contraction, with every round cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learntrace.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A row ``node``, ``root`` for each node of the links; nodes that are linked share their root.

    In each round a node points at the neighbour (or itself) of least priority, a hash of the node, so
    chains are short and the graph shrinks by a constant factor, and a star, whatever its size, is one node after two
    rounds; one pointer jump follows, and links are renamed and made distinct. Degrees are met by partial aggregation and by
    joins that adaptive execution can split; they merge sorted rows, so that nothing passes the driver. The rounds'
    parents are composed at the end. An empty table gives an empty table."""
    e = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct())
    parents: list[DataFrame] = []
    while not parents or not e.isEmpty():
        way = lambda x: F.struct(F.xxhash64(F.col(x)).alias("p"), F.col(x).alias("n"))
        both = e.select("a", "b").union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min(way("b")).alias("m"))
        up = stored(least.select(F.col("a").alias("node"), F.least(way("a"), F.col("m"))["n"].alias("up")))
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        parent = up.join(jump.hint("merge"), "up").select("node", "root")
        at = lambda x: parent.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")).hint("merge")  # noqa: E731, B023
        e = stored(e.join(at("a"), "a").join(at("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b").distinct())
        parents.append(parent)
    found = parents[0]
    for parent in parents[1:]:
        step = parent.select(F.col("node").alias("root"), F.col("root").alias("next")).hint("merge")
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored(found)
