"""Exact nearest neighbours of vectors by layer, with blocks that the triangle inequality leaves out.

Training rows are cut into cells around pivots (a bounded sample), cells into blocks of bounded bytes. A query first meets one
block of its own cell; the k-th distance there, or what the cells' sizes and radii promise, bounds its k-th distance overall. Then it
meets only blocks whose ball may hold something as near. All that two blocks do is one matrix product and an exact recheck. Neither side is broadcast:
only pivots, radii and sizes are, a number of values that is bounded. A layer of one block has no pivots and no second round.

Where vectors have no clusters the bound leaves out little, and the work is that of all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learntrace.functions.matrices import matrix
from learntrace.functions.vectors import doubles
from learntrace.session import stored

BLOCK_ROWS, BLOCK_BYTES = 50_000, 32 << 20  # of a block, whichever is less
PIVOTS_PER_BLOCK, MAX_PIVOTS = 2, 1_024
CHUNK_PAIRS = 1 << 19  # distances held at once
PART = 16  # one row of as many, drawn, tells a first bound
COARSE = 0.05  # of the squared k-th distance: the rounding that single precision may have
BROADCAST_GROUPS = 200_000

KEY = ["layer_idx", "cell", "sub", "part"]
PLACED = "layer_idx int, cell int, sub int, part int, example_id long, label int, act array<double>"
FIRST = "layer_idx int, cell int, sub int, query_id long, act array<double>, d array<double>, label array<int>, train_id array<long>"
FOUND = "layer_idx int, query_id long, d double, label int, train_id long"


@dataclass
class Layer:
    """What the tasks know of a layer: pivots, and each cell's rows, radius, blocks, parts of the queries that meet one of
    its blocks first, and parts of its queries when they meet others."""

    block_rows: int
    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    parts: np.ndarray
    later_parts: np.ndarray


def closest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and distances of each row's k nearest, ties by id; with a ``bound`` a row, those within it.

    A part of ``b`` tells a distance that the k-th does not exceed. |a|^2 + |b|^2 - 2ab, a matrix product, tells which rows may lie
    within it up to rounding; those are measured directly, so that the choice is that of exact distances. What is rounded grows with the
    squares, so both sides are first moved by the mean of ``b``, and the product is in single precision only where its rounding is a
    small part (``COARSE``) of that distance: else most rows would be measured directly."""
    k = min(k, len(b))
    middle = b.mean(axis=0)
    x, y = a - middle, b - middle
    aa, bb = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = 4 * (a.shape[1] + 8) * (aa + bb.max(initial=0))  # in units of the last place
    some = np.random.default_rng(0).permutation(len(b))[: -(-len(b) // max(1, min(PART, len(b) // (4 * k))))]  # no order of the rows is taken for granted
    sides = {np.float64: (x, y.T, bb / 2)}
    if max(aa.max(initial=0), bb.max(initial=0)) < 1e30:
        sides[np.float32] = tuple(v.astype(np.float32) for v in sides[np.float64])
    out, step = [], max(1, CHUNK_PAIRS // max(1, len(b)))
    for first in range(0, len(a), step):
        own = slice(first, first + step)
        within = np.full(len(a[own]), np.inf) if bound is None else bound[own] ** 2
        if not np.isfinite(within).all():
            within = np.minimum(within, np.partition(aa[own, None] + bb[some] - 2.0 * (x[own] @ y[some].T), k - 1, axis=1)[:, k - 1])
        single = np.float32 in sides and np.median(slack[own]) * 2.0**-23 <= COARSE * np.median(within)
        kind, unit = (np.float32, 2.0**-23) if single else (np.float64, 2.0**-52)
        own_a, own_b, half = sides[kind]
        near = own_a[own] @ own_b
        near -= half
        least = (aa[own] - within - slack[own] * unit - 1e-30) / 2
        row, col = np.divmod(np.flatnonzero(near >= least.astype(kind)[:, None]), len(b))
        d = np.sqrt(((a[own][row] - b[col]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        counts = np.bincount(row, minlength=len(a[own]))
        kept = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < k
        out.append((row[kept] + first, col[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def checked_sizes(rows: DataFrame, what: str) -> dict[int, tuple[int, int]]:
    """Rows and numbers a vector of each layer, in one pass. Null, NaN or infinite values and unequal lengths are a
    ValueError that names a row: such a row has no distance, and leaving it out would change its neighbours in silence."""
    act = F.col("act")
    bad = act.isNull() | F.exists(act, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    told = rows.groupBy("layer_idx").agg(F.count("*").alias("n"), F.min(F.size("act")).alias("least"), F.max(F.size("act")).alias("most"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("example_id"))).alias("which")).collect()  # layers: tens
    for r in told:
        if r["bad"]:
            raise ValueError(f"{what}: {r['bad']} vectors of layer {r['layer_idx']} hold null, NaN or infinite values, that of example {r['which']} first")
        if r["least"] != r["most"]:
            raise ValueError(f"{what}: layer {r['layer_idx']} has vectors of {r['least']} to {r['most']} numbers")
    return {r["layer_idx"]: (r["n"], r["most"]) for r in told}


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def _drawn(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A number below ``n`` for each id, the same everywhere."""
    return (((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _batches(rows: DataFrame, shared: object, fn: Callable[[int, Layer, pa.RecordBatch], list], names: list[str], schema: str) -> DataFrame:
    """``fn`` of each layer's rows in Arrow batches: columns, or nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("layer_idx").to_numpy()
            for layer in np.unique(own).tolist():
                part = batch.filter(pa.array(own == layer)) if len(own) and (own != layer).any() else batch
                if layer not in shared.value:
                    continue
                for at in range(0, part.num_rows, 2048):
                    columns = fn(layer, shared.value[layer], part.slice(at, 2048))
                    if columns and len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    return rows.mapInArrow(run, schema)


def _pivots(train: DataFrame, sizes: dict[int, tuple[int, int]], rows_of: dict[int, int]) -> dict[int, np.ndarray]:
    """Pivots of every layer that has more than one block: a bounded sample by a hash of the id."""
    wanted = {i: min(MAX_PIVOTS, PIVOTS_PER_BLOCK * -(-n // rows_of[i])) for i, (n, _) in sizes.items() if n > rows_of[i]}
    found = {i: np.zeros((1, d)) for i, (_, d) in sizes.items()}
    if wanted:
        below = F.lit(False)
        for i, p in wanted.items():
            below = below | (F.col("layer_idx").eqNullSafe(i) & (F.xxhash64("example_id", F.lit(7)) <= F.lit(min(2**64, 2 * p * 2**64 // sizes[i][0]) - 2**63 - 1)))
        drawn = train.where(below).select("layer_idx", "example_id", "act").toArrow().sort_by("example_id")
        for i, p in wanted.items():
            own = drawn.filter(pa.compute.equal(drawn.column("layer_idx"), i)).column("act").combine_chunks()
            if len(own):
                found[i] = np.unique(matrix(own)[:p], axis=0)
    return found


class Index:
    """The cells and blocks of the training rows, and what meets what."""

    def __init__(self, train: DataFrame, queries: DataFrame, block_rows: int | None = None) -> None:
        shaped = lambda df, *more: df.select(F.col("layer_idx").cast("int"), F.col("example_id").cast("long"), *more, doubles(F.col("act")).alias("act"))
        self.train, self.queries = shaped(train, F.col("label").cast("int")), shaped(queries)
        sizes = checked_sizes(self.train, "training rows")
        asked = sizes if queries is train else checked_sizes(self.queries, "queries")
        off = {i: (asked[i][1], sizes[i][1]) for i in asked if i in sizes and asked[i][1] != sizes[i][1]}
        if off:
            raise ValueError(f"queries and training rows differ in length: {off}")
        rows_of = {i: max(1, min(block_rows or BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, d)))) for i, (_, d) in sizes.items()}
        pivots = _pivots(self.train, sizes, rows_of)
        self.layers = {i: Layer(rows_of[i], pivots[i], np.array([n]), np.array([np.inf]), np.ones(1, dtype=int), *[np.array([max(1, -(-asked.get(i, (0, 0))[0] // rows_of[i]))])] * 2) for i, (n, _) in sizes.items()}
        self.many = any(n > rows_of[i] for i, (n, _) in sizes.items())
        if self.many:
            self._measure(queries is train)
        self.shared = train.sparkSession.sparkContext.broadcast(self.layers)

    def _cells(self, rows: DataFrame) -> list:
        """Rows and radius of every cell: at most the pivots."""
        def cell(i: int, layer: Layer, part: pa.RecordBatch) -> list:
            d = _to_pivots(matrix(part.column("act")), layer.pivots)
            return [np.full(len(d), i, dtype=np.int32), d.argmin(axis=1).astype(np.int32), d.min(axis=1)]

        shared = rows.sparkSession.sparkContext.broadcast(self.layers)
        return _batches(rows, shared, cell, ["layer_idx", "cell", "d"], "layer_idx int, cell int, d double").groupBy("layer_idx", "cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()

    def _measure(self, same: bool) -> None:
        mine = self._cells(self.train)
        theirs = mine if same else self._cells(self.queries)
        for i, layer in self.layers.items():
            size = len(layer.pivots)
            layer.rows, layer.radius, asked = np.zeros(size, dtype=np.int64), np.zeros(size), np.zeros(size, dtype=np.int64)
            for r in mine:
                if r["layer_idx"] == i:
                    layer.rows[r["cell"]], layer.radius[r["cell"]] = r["n"], r["r"]
            for r in theirs:
                if r["layer_idx"] == i:
                    asked[r["cell"]] = r["n"]
            layer.blocks = np.maximum(1, -(-layer.rows // layer.block_rows))
            layer.parts = np.maximum(1, -(-asked // (layer.blocks * layer.block_rows)))
            layer.later_parts = np.maximum(1, -(-asked // layer.block_rows))

    def placed(self, copies: bool) -> DataFrame:
        """Training rows with their cell and block, once for each part of its queries (``copies``) or once."""
        def place(i: int, layer: Layer, part: pa.RecordBatch) -> list:
            x, ids = matrix(part.column("act")), part.column("example_id").to_numpy()
            cell = _to_pivots(x, layer.pivots).argmin(axis=1)
            times = layer.parts[cell] if copies else np.ones(len(cell), dtype=int)
            row = np.repeat(np.arange(len(cell)), times)
            number = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            kept = part.take(pa.array(row))
            return [np.full(len(row), i, dtype=np.int32), cell[row].astype(np.int32), _drawn(ids, layer.blocks[cell])[row].astype(np.int32), number.astype(np.int32), kept.column("example_id"), kept.column("label"), kept.column("act")]

        return _batches(self.train, self.shared, place, [*KEY, "example_id", "label", "act"], PLACED)

    def asked(self) -> DataFrame:
        """Queries with the block of their own cell that they meet first."""
        def ask(i: int, layer: Layer, part: pa.RecordBatch) -> list:
            ids = part.column("example_id").to_numpy()
            cell = _to_pivots(matrix(part.column("act")), layer.pivots).argmin(axis=1)
            filled = layer.rows[cell] > 0
            cell = np.where(filled, cell, int(np.argmax(layer.rows)))
            sub, of = _drawn(ids, layer.blocks[cell]), layer.blocks[cell] * layer.parts[cell]
            return [np.full(len(ids), i, dtype=np.int32), cell.astype(np.int32), sub.astype(np.int32), (_drawn(ids, of) // layer.blocks[cell]).astype(np.int32), part.column("example_id"), part.column("act")]

        return _batches(self.queries, self.shared, ask, [*KEY, "example_id", "act"], "layer_idx int, cell int, sub int, part int, example_id long, act array<double>")

    def first(self, k: int) -> DataFrame:
        """A row a query: its k nearest of the block that it meets first."""
        def pair(q: pa.Table, t: pa.Table) -> pa.Table:
            if not q.num_rows or not t.num_rows:
                return pa.table({n: [] for n in ("layer_idx", "cell", "sub", "query_id", "act", "d", "label", "train_id")}, schema=_arrow(FIRST))
            q, t = q.combine_chunks(), t.combine_chunks()
            ids, labels, act = t.column("example_id").to_numpy(), t.column("label").to_numpy(), q.column("act").combine_chunks()
            row, col, d = closest(matrix(act), matrix(t.column("act").combine_chunks()), ids, k)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=q.num_rows))].astype(np.int32))
            several = lambda v: pa.ListArray.from_arrays(ends, pa.array(v))
            return pa.table([*[q.column(c) for c in ("layer_idx", "cell", "sub", "example_id")], act, several(d), several(labels[col].astype(np.int32)), several(ids[col])], schema=_arrow(FIRST))

        return self.asked().groupBy(*KEY).cogroup(self.placed(True).groupBy(*KEY)).applyInArrow(pair, FIRST)

    def _meet(self, first: DataFrame, k: int, keys_only: bool) -> DataFrame:
        """Queries for every further block that may hold one of their k nearest."""
        def meet(i: int, layer: Layer, part: pa.RecordBatch) -> list:
            x, ids = matrix(part.column("act")), part.column("query_id").to_numpy()
            to = _to_pivots(x, layer.pivots)
            filled = np.flatnonzero(layer.rows)
            outer = (to + layer.radius)[:, filled]
            order = np.argsort(outer, axis=1)
            enough = (np.cumsum(layer.rows[filled][order], axis=1) >= k).argmax(axis=1)
            bound = np.take_along_axis(outer, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0] if layer.rows.sum() >= k else np.full(len(x), np.inf)
            d = part.column("d")
            had = np.array([v[-1] if v is not None and len(v) >= k else np.inf for v in d.to_pylist()])
            bound = np.minimum(bound, had)
            row, cell = np.nonzero((to - layer.radius <= (bound + 1e-9 * (bound + 1))[:, None]) & (layer.rows > 0))
            times = layer.blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            sub = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            other = (cell != part.column("cell").to_numpy()[row]) | (sub != part.column("sub").to_numpy()[row])
            row, cell, sub = row[other], cell[other], sub[other]
            own = part.column("cell").to_numpy()  # queries of one cell go together, for they meet the same blocks
            group = (np.cumsum(layer.later_parts) - layer.later_parts)[own] + _drawn(ids, layer.later_parts[own])
            key = [np.full(len(row), i, dtype=np.int32), cell.astype(np.int32), sub.astype(np.int32), group[row].astype(np.int32)]
            if keys_only:
                return list(np.unique(np.column_stack(key), axis=0).T.astype(np.int32)) if len(row) else []
            return [*key, pa.array(ids[row]), part.column("act").take(pa.array(row)), pa.array(bound[row])]

        names = KEY if keys_only else [*KEY, "example_id", "act", "bound"]
        schema = "layer_idx int, cell int, sub int, part int" + ("" if keys_only else ", example_id long, act array<double>, bound double")
        return _batches(first.select("layer_idx", "cell", "sub", "query_id", "act", "d"), self.shared, meet, names, schema)

    def meetings(self, first: DataFrame, k: int) -> DataFrame:
        """The groups of the second round: blocks and the parts of the queries that meet them."""
        return self._meet(first, k, True).distinct()

    def second(self, first: DataFrame, k: int) -> DataFrame:
        groups = stored(self.meetings(first, k))
        groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
        train = self.placed(False).drop("part").join(groups, KEY[:3]).select(*[F.col(c).alias(f"t_{c}") for c in KEY], "example_id", "label", "act")

        def pair(q: pa.Table, t: pa.Table) -> pa.Table:
            if not q.num_rows or not t.num_rows:
                return pa.table({n: [] for n in ("layer_idx", "query_id", "d", "label", "train_id")}, schema=_arrow(FOUND))
            ids, labels = t.column("example_id").to_numpy(), t.column("label").to_numpy()
            bound = q.column("bound").to_numpy() * (1 + 1e-9) + 1e-9
            row, col, d = closest(matrix(q.column("act").combine_chunks()), matrix(t.column("act").combine_chunks()), ids, k, bound)
            near = d <= bound[row]
            row, col, d = row[near], col[near], d[near]
            return pa.table([q.column("layer_idx").take(row), q.column("example_id").take(row), pa.array(d), pa.array(labels[col].astype(np.int32)), pa.array(ids[col])], schema=_arrow(FOUND))

        return self._meet(first, k, False).groupBy(*KEY).cogroup(train.groupBy(*[f"t_{c}" for c in KEY])).applyInArrow(pair, FOUND)


def _arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL of plain columns and arrays."""
    plain = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    kind = lambda t: pa.list_(plain[t[6:-1]]) if t.startswith("array") else plain[t]
    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in schema.split(", ")])


def nearest(train: DataFrame, queries: DataFrame, k: int = 30, block_rows: int | None = None) -> DataFrame:
    """The k nearest training rows of each query in its layer: layer_idx, query_id, d, label, train_id.

    Ties go to the smaller id. Vectors with null, NaN or infinite values are a ValueError."""
    index = Index(train, queries, block_rows)
    first = index.first(k)
    first = stored(first) if index.many else first
    several = F.explode(F.arrays_zip("d", "label", "train_id")).alias("s")
    found = first.select("layer_idx", "query_id", several).select("layer_idx", "query_id", "s.d", "s.label", "s.train_id")
    if not index.many:
        return found  # every query met its whole layer
    best = Window.partitionBy("layer_idx", "query_id").orderBy("d", "train_id")
    return found.unionByName(index.second(first, k)).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
