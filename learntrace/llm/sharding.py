"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. The rows of each input partition are counted; the driver draws, partition by partition, how many
   of its rows go to each shard (multivariate hypergeometric, so the columns sum to the shard sizes
   exactly). The matrix has a row for each partition, so its size follows the partitions, which are
   merged above ``MAX_PARTITIONS``, and not the rows.
2. Each partition permutes its shard labels locally and hands them to its rows as they stream by.
3. Rows are exchanged by shard and block and permuted again: ordered by random keys. A block is a
   range of the keys with ``BLOCK_ROWS`` expected rows at any size; its first slot is the number of rows
   in the shard's blocks before it.

Draws are exact at any size: numpy's sampler below its bound of 10^9 rows, and beyond it inversion over the
exact ratios of neighbouring probabilities. Every random number is drawn from the seed and the partition's
number over checkpointed rows, so a task that runs again repeats its choices.

Defined results: a null text has size 16 and checksum 0; repeated rows and null keys are rows like
any other; rows of equal random keys stand in the order of their partition; columns of any type are carried
along; an empty table gives an empty table; shards left without rows have no slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learntrace.llm.common import BROADCAST_ROWS, columns
from learntrace.session import cut

SHARDS = 40
SEED = 42
MAX_PARTITIONS = 20_000
BLOCK_ROWS = 1_000  # expected rows of a block
OVERHEAD = 16
NUMPY_BOUND = 10**9  # numpy draws from smaller urns only
TAIL = 1e-22  # share of the mode's probability below which counts are not drawn


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, np.ndarray]:
    """Rows of each partition for each shard; column sums are at most one apart."""
    total = sum(counts.values())
    rng = np.random.default_rng([seed, 0])
    left = np.full(shards, total // shards, dtype=np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    drawn = {}
    for p in sorted(counts):
        drawn[p] = _draw(rng, left, counts[p])
        left = left - drawn[p]
    return drawn


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric by marginals; the totals may pass numpy's bound of 10^9."""
    out = np.zeros_like(left)
    rest = int(left.sum())
    for s, k in enumerate(left.tolist()):
        if n <= 0:
            break
        rest -= k
        out[s] = n if rest == 0 else _hypergeometric(rng, k, rest, n)
        n -= int(out[s])
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if not n or not good or not bad:
        return n if not bad else 0
    if good + bad < NUMPY_BOUND:
        return int(rng.hypergeometric(good, bad, n))
    first, weights = _probabilities(good, bad, n)
    return first + int(np.searchsorted(np.cumsum(weights), rng.random(), side="right"))


def _probabilities(good: int, bad: int, n: int) -> tuple[int, np.ndarray]:
    """The hypergeometric probabilities of ``n`` draws, from a first count on. They follow from the mode by
    the ratios p(k + 1) / p(k) = (good - k)(n - k) / ((k + 1)(bad - n + k + 1)), as far as they exceed ``TAIL``
    of the mode's: some 20 standard deviations, however large the urn."""
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    step = 1024 + int(4 * (n * good / (good + bad)) ** 0.5)

    def side(towards: int) -> np.ndarray:
        """Logarithms of p / p(mode) beyond the mode, outwards."""
        found, at, last = [], mode, 0.0
        while at != (high if towards > 0 else low) and last > np.log(TAIL):
            k = np.arange(at, min(high, at + step), dtype=float) if towards > 0 else np.arange(at - 1, max(low, at - step) - 1, -1, dtype=float)
            ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
            found.append(last + np.cumsum(towards * ratio))
            at, last = at + towards * len(k), found[-1][-1]
        return np.concatenate(found) if found else np.zeros(0)

    below, above = side(-1)[::-1], side(1)
    weights = np.exp(np.concatenate([below, [0.0], above]))
    return mode - len(below), weights / weights.sum()


def assign(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform random order cut into shards of equal size.

    Columns shard and slot of the input are replaced. The rows are written to the checkpoint folder once; keep only
    the columns that are needed, and join the payload by key where it is large."""
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    held = cut(rows.select(*[c.alias(f"_lt_{i}") for i, c in enumerate(columns(rows, "shard", "slot"))]))
    if held.rdd.getNumPartitions() > MAX_PARTITIONS:
        held = cut(held.coalesce(MAX_PARTITIONS))
    counts = {r["p"]: r["n"] for r in held.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    matrix = held.sparkSession.sparkContext.broadcast(communication_matrix(counts, shards, seed))
    total = sum(counts.values())
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    schema = T.StructType([*held.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("_lt_u", T.LongType()), T.StructField("_lt_i", T.LongType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        row = matrix.value.get(p)
        if row is None:
            return
        rng = np.random.default_rng([seed, 1, p])
        labels = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
        at = 0
        for b in batches:
            own = labels[at : at + b.num_rows]
            keys, places = rng.integers(0, 2**62, b.num_rows, dtype=np.int64), (p << 40) + np.arange(at, at + b.num_rows, dtype=np.int64)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(keys, pa.int64()), pa.array(places, pa.int64())], names=schema.names)

    dealt = held.mapInArrow(label, schema).withColumn("_lt_block", F.floor(F.col("_lt_u") / F.lit(2.0**62) * blocks).cast("int"))
    sizes = dealt.groupBy("shard", "_lt_block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_lt_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "_lt_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lt_first"))
    order = Window.partitionBy("shard", "_lt_block").orderBy("_lt_u", "_lt_i")
    ranked = dealt.withColumn("_lt_rank", F.row_number().over(order))
    slot = (F.col("_lt_first") + F.col("_lt_rank") - 1).cast("long").alias("slot")
    own = [F.col(f"_lt_{i}").alias(n) for i, n in enumerate(names)]
    firsts = F.broadcast(firsts) if shards * blocks <= BROADCAST_ROWS else firsts  # else both sides lie by shard and block
    return ranked.join(firsts, ["shard", "_lt_block"]).select(*own, "shard", slot)


def shard_digest(docs: DataFrame) -> DataFrame:
    """The query's columns; the law is ``rows``."""
    slim = docs.select("doc_id", row_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = assign(slim)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
