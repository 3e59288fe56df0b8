"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors, about ``PIVOTS_PER_ROOT`` times the square root of their number,
and thinned until no two are alike, so that a crowd of near copies has one pivot and not many that its members would divide between. A vector is
described by its ``PREFIX`` nearest pivots in order and posted in the inverted lists of the first ``POSTED`` of them. Two
vectors that meet in a list and share ``SHARED`` pivots of their descriptions are compared by cosine in double precision;
of the lists that a pair meets in, the first one counts it, so that numbers of partners add up without a pair ever
being written: a list gives its members' numbers and a spanning forest of its links.

Equal vectors are one before they are posted. A long list is cut into blocks that meet in pairs, each in a group of its own.
Lists are about as long as there are pivots, so comparisons grow with the power 1.5 of the vectors; a crowd of
near copies costs the square of its different vectors, for each has to know how many partners it has.

The search is not exhaustive: of pairs at cosine 0.9501 of random vectors without any structure it finds 0.97, of
closer pairs and in crowds nearly all (tests measure both).

Defined results: vectors that are null, empty or zero or hold null, NaN or infinite components link with nothing, nor do vectors of
different lengths; equal vectors are linked; repeated rows and ids are rows like any other; a null vec_id counts as a
partner and names a component only if it is alone; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.llm.common import small_side
from learntrace.llm.components import components
from learntrace.session import stored

COSINE = 0.95
PREFIX, POSTED, SHARED = 6, 3, 2
PIVOTS_PER_ROOT, LEAST_PIVOTS, ALIKE = 4, 16, 0.7
MAX_PIVOTS, MAX_PIVOT_VALUES = 16_384, 4_000_000  # bounds of the pivots that are gathered, in rows and numbers
BLOCK = 2_048  # vectors of a list that meet in one group, on each side
STRIPE = 256  # of them compared at a time

POSTING = "pivot int, dim int, h long, g long, n long, nearest array<int>, values binary"
FOUND = "h long, g long, links long, h2 long, g2 long"


def _node(vector: Column) -> list[Column]:
    """A vector's name: 128 bits of hashes."""
    return [F.xxhash64(vector).alias("h"), F.xxhash64(F.lit("second"), vector).alias("g")]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``v`` and the name of vectors that may link."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(key).alias("id"), v.alias("v"), *_node(v))


def units(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of norm 1 in double precision, shorter ones filled up with zeros."""
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    x = np.zeros((len(column), width))
    sizes = np.diff(offsets)
    x[np.repeat(np.arange(len(column)), sizes), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0] : offsets[-1]]
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def thinned(candidates: np.ndarray, most: int, alike: float = ALIKE) -> np.ndarray:
    """The first candidates of which no two have a cosine of ``alike`` or more."""
    kept = np.empty((most, candidates.shape[1]))
    n = 0
    for x in candidates:
        if n < most and (n == 0 or (kept[:n] @ x).max() < alike):
            kept[n] = x
            n += 1
    return kept[:n]


def choose_pivots(rows: DataFrame) -> np.ndarray:
    """Pivots of usable vectors: a bounded sample by hash, the same whatever the order of rows, then thinned."""
    size = rows.agg(F.approx_count_distinct("h", 0.02).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return np.empty((0, 0))
    bound = max(1, min(MAX_PIVOTS, MAX_PIVOT_VALUES // size["width"]))
    most = min(bound, max(LEAST_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(size["n"]))))
    least = min(2**64, 3 * most * 2**64 // size["n"]) - 2**63
    drawn = rows.where(F.col("h") <= F.lit(least - 1)).groupBy("h", "g", "v").agg(F.lit(1)).orderBy("h", "g").limit(2 * most).select("v").toArrow()
    return thinned(units(drawn.column("v").combine_chunks(), size["width"]), most) if drawn.num_rows else np.empty((0, 0))


def postings(distinct: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Distinct vectors (v, h, g, n) with their nearest pivots, once for each list that they are posted in."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                x = units(part.column("v"), at.shape[1])
                dims = np.diff(part.column("v").offsets.to_numpy())
                near = x @ at.T
                depth, lists = min(PREFIX, len(at)), min(POSTED, len(at))
                some = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
                order = np.lexsort((some, -np.take_along_axis(near, some, 1)), axis=1)
                nearest = np.take_along_axis(some, order, 1).astype(np.int32)
                row = np.repeat(np.arange(len(x)), lists)
                data, of = pa.array(_bytes(part.column("v")), pa.binary()), pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest[:, :lists].ravel()), pa.array(dims[row].astype(np.int32)), *[part.column(c).take(of) for c in ("h", "g", "n")], pa.array(list(nearest)).take(of), data.take(of)],
                    names=["pivot", "dim", "h", "g", "n", "nearest", "values"],
                )

    return distinct.select("v", "h", "g", "n").mapInArrow(post, POSTING)


def _bytes(column: pa.ListArray) -> list[bytes]:
    """The vectors' own bytes: single precision stays half as long, and as exact."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    values = values if values.dtype == np.float32 else values.astype(float)
    return [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def dealt(posted: DataFrame) -> DataFrame:
    """Postings by group: a list as it is, or its blocks in pairs (i, j), i <= j, each row with its ``side``."""
    sizes = stored(posted.groupBy("pivot", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    long = posted.join(small_side(sizes.withColumnsRenamed({"pivot": "_p", "dim": "_d"})), (F.col("pivot") == F.col("_p")) & (F.col("dim") == F.col("_d")), "left").drop("_p", "_d")
    own = F.pmod(F.col("g"), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own <= j, 0).otherwise(1).alias("side")))
    once = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    return long.select("*", F.explode(F.when(F.col("blocks").isNull(), once).otherwise(meet)).alias("m")).select("pivot", "dim", "m.i", "m.j", "m.side", "h", "g", "n", "nearest", "values")


def _links(x: np.ndarray, nearest: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Linked rows of the left and the right side, by stripes, and whether this list counts the pair."""
    same = left is right
    for first in range(0, len(left), STRIPE):
        rows = left[first : first + STRIPE]
        shared = np.zeros((len(rows), len(right)), dtype=np.int8)
        for a in range(nearest.shape[1]):
            for b in range(nearest.shape[1]):
                shared += nearest[rows, a][:, None] == nearest[right, b][None, :]
        near = x[rows] @ x[right].T
        found = (near >= cosine - 1e-12) & (shared >= min(SHARED, nearest.shape[1]))
        if same:
            found &= np.arange(first, first + len(rows))[:, None] < np.arange(len(right))[None, :]
        r, c = np.nonzero(found)
        sure = near[r, c] >= cosine + 1e-12
        for k in np.flatnonzero(~sure).tolist():  # within rounding of the threshold: the sum without rounding decides
            sure[k] = math.fsum((x[rows[r[k]]] * x[right[c[k]]]).tolist()) >= cosine
        r, c = rows[r[sure]], right[c[sure]]
        before = np.full(len(r), pivot)
        lists = min(POSTED, nearest.shape[1])
        for a in range(lists):
            for b in range(lists):
                p = nearest[r, a]
                before = np.where((p == nearest[c, b]) & (p < before), p, before)
        yield r, c, before == pivot


def _forest(up: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Roots of rows after more links, by rounds of the smallest label; ``up`` changes in place."""
    while len(r):
        a, b = up[r], up[c]
        differ = a != b
        r, c, a, b = r[differ], c[differ], a[differ], b[differ]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up[:] = up[up]


def _compared(batches: Iterator[pa.RecordBatch], cosine: float, single: bool) -> Iterator[pa.RecordBatch]:
    """From postings sorted by group: the members' numbers of partners and links that join the linked ones."""
    names = ("h", "g", "links", "h2", "g2")

    def group(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        pivot, dim, i, j = (t.column(c)[0].as_py() for c in ("pivot", "dim", "i", "j"))
        h, g, n, side = (t.column(c).to_numpy() for c in ("h", "g", "n", "side"))
        x = np.frombuffer(b"".join(t.column("values").to_pylist()), dtype=np.float32 if single else float).reshape(len(h), dim).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        nearest = np.stack(t.column("nearest").to_pylist()).astype(np.int32)
        left = np.flatnonzero(side == 0)
        right = left if i == j else np.flatnonzero(side == 1)
        links, up = np.zeros(len(h), dtype=np.int64), np.arange(len(h))
        for r, c, counts in _links(x, nearest, left, right, pivot, cosine):
            links += np.bincount(r[counts], weights=n[c[counts]], minlength=len(h)).astype(np.int64)
            links += np.bincount(c[counts], weights=n[r[counts]], minlength=len(h)).astype(np.int64)
            _forest(up, r, c)
        linked = np.flatnonzero((links > 0) | (up != np.arange(len(h))))
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (h[linked], g[linked], links[linked], h[up[linked]], g[up[linked]])], names=names)

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        keys = np.column_stack([t.column(c).to_numpy() for c in ("pivot", "dim", "i", "j")])
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip(np.r_[0, ends[:-1]].tolist() if len(ends) else [], ends.tolist(), strict=True):
            if (found := group(t.slice(a, b - a))) is not None:
                yield found
        rest = t.slice(int(ends[-1])) if len(ends) else t
    if rest is not None and (found := group(rest)) is not None:
        yield found


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``key``, ``n_links`` (other rows linked directly) and ``component_id``, the smallest key reachable over links."""
    rows = usable(vectors, key, vector)
    pivots = choose_pivots(rows)
    told = vectors.select(F.col(key).alias("id"), *_node(F.col(vector)))
    if not len(pivots):
        return told.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    distinct = stored(rows.groupBy("h", "g", "v").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    posted = postings(distinct, pivots)
    groups = dealt(posted).repartition("pivot", "dim", "i", "j").sortWithinPartitions("pivot", "dim", "i", "j")
    found = stored(groups.mapInArrow(lambda batches: _compared(batches, cosine, single), FOUND))
    node = lambda h, g: F.struct(F.col(h).alias("h"), F.col(g).alias("g"))
    roots = components(found.select(node("h", "g").alias("a"), node("h2", "g2").alias("b"))).select("node.h", "node.g", "root")
    partners = found.groupBy("h", "g").agg(F.sum("links").alias("links"))
    known = distinct.select("h", "g", "n", "least").join(partners.hint("merge"), ["h", "g"], "left").where("n > 1 or links is not null")
    known = stored(known.join(roots.hint("merge"), ["h", "g"], "left").select("h", "g", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", node("h", "g")).alias("root")))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = known.join(named.hint("merge"), "root").select(F.col("h").alias("_h"), F.col("g").alias("_g"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    joined = told.join(by_node.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``vectors`` without those whose component has a smaller key; keys are taken to be unique."""
    gone = near_vectors(vectors, key, vector, cosine).where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_lt_gone"))
    return vectors.join(gone, F.col(key) == F.col("_lt_gone"), "left_anti")


def embedding_digest(vectors: DataFrame) -> DataFrame:
    """The query's columns: links, component and whether the vector is its component's first."""
    return near_vectors(vectors.select("vec_id", "embedding")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
