"""Best-fit packing by patterns: non-negative least squares over few-document length patterns.

Documents become token pieces of at most the sequence length. The histogram of piece lengths (at most
4,096 numbers, whatever the input) goes to the driver, which enumerates patterns of up to four lengths
that fill a sequence, fits their repeat counts to the histogram by non-negative least squares, rounds
them down to what there is, and packs the residual histogram by best fit, decreasing, on counts. The
plan says, for each length, which ranks go to which repeats of which pattern; pieces are ranked within
their length in salted cells, so a length that a third of all documents share is no single group.

Defined results: a null or empty text is one piece holding only the end id; repeated rows are packed
each on their own; texts are tokenized whole, however long, and cut into as many pieces as they need; rows of one key, null or not, are
documents of their own; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from learntrace.session import cut

LENGTH = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CELL_ROWS, MAX_CELLS = 256, 20_000
CACHE_WORDS, CACHE_CHARS = 500_000, 40  # of a Python worker's cache of parts, which is emptied when full
PATTERNS = 40_000


class WordTokens:
    """Ids of whole texts by way of a cache of their parts.

    The tokenizer drops white space and treats letter runs, single digits and other runs apart, so a
    text's ids are its parts' ids in order. Texts of ASCII and precomposed Latin-1 letters without an
    apostrophe (their normal form is themselves) split into these parts here; other texts split at
    ASCII white space only; texts that name a special token go to the tokenizer whole."""

    _PLAIN = re.compile("[\\x00-\\x1b\\x20-&(-\\x7f\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]*")
    _PARTS = re.compile("[a-z\\xdf-\\xf6\\xf8-\\xff]+|[0-9]|[^\\x20\\t-\\ra-z0-9\\xdf-\\xf6\\xf8-\\xff]+")

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" in text:
            return self._encode(text)
        split = self._PARTS.findall(text.lower()) if self._PLAIN.fullmatch(text) else re.split("[\\x20\\t-\\r]+", text)
        known = self.parts
        new = [x for x in dict.fromkeys(split) if x not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(dict.fromkeys(split))
            for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[x] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        out = b"".join([known[x] for x in split])
        for x in new:
            if len(x) > CACHE_CHARS:
                del known[x]
        return out


@cache
def _tokens(tokenizer: str) -> WordTokens:
    """A worker's tokenizer: a path, or the name of a public file that is looked up on the worker's machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return WordTokens(tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer))


PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """A row for each piece: key, piece, start, length and checksum of its ids."""
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema.fields[0], *PIECE.fields])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for b in batches:
            of, rows = [], []
            for i, text in enumerate(b.column(1)):
                ids = tokens.ids(text.as_py()) + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, length)):
                    part = ids[4 * at : 4 * (at + length)]
                    of.append(i)
                    rows.append((k, at, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], names=schema.names)

    return rows.mapInArrow(cut_up, schema)


def patterns(counts: np.ndarray, length: int, most: int = PATTERNS) -> np.ndarray:
    """Few-document patterns as rows of up to four lengths (0: none) that best fill a sequence.

    ``counts[n]`` is the number of pieces of length n. First lengths run over all there are; second
    and third ones over a grid of what there is; the last is the longest that still fits."""
    have = np.flatnonzero(counts)
    have = have[(have > 0) & (have < length)]
    if not len(have):
        return np.zeros((0, 4), dtype=np.int64)
    fits = np.zeros(length + 1, dtype=np.int64)  # longest available length up to n
    fits[have] = have
    fits = np.maximum.accumulate(fits)
    grid = have[np.unique(np.linspace(0, len(have) - 1, min(len(have), max(2, most // max(1, 3 * len(have))))).astype(int))]
    coarse = have[np.unique(np.linspace(0, len(have) - 1, min(len(have), 24)).astype(int))]
    two = np.column_stack([have, fits[length - have], np.zeros_like(have), np.zeros_like(have)])
    a, b = (x.ravel() for x in np.meshgrid(have, grid, indexing="ij"))
    ok = a + b < length
    three = np.column_stack([a[ok], b[ok], fits[length - a[ok] - b[ok]], np.zeros(ok.sum(), dtype=np.int64)])
    a, b, c = (x.ravel() for x in np.meshgrid(have[:: max(1, len(have) // 200)], coarse, coarse, indexing="ij"))
    ok = a + b + c < length
    four = np.column_stack([a[ok], b[ok], c[ok], fits[length - a[ok] - b[ok] - c[ok]]])
    found = np.unique(-np.sort(-np.concatenate([two, three, four]), axis=1), axis=0)
    return found[found.sum(axis=1) >= length - 2] if (found.sum(axis=1) >= length - 2).any() else found[found.sum(axis=1) >= 0.97 * length]


def fit_counts(found: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of least squared error between the patterns' lengths and the histogram,
    by projected gradient steps with momentum."""
    n = len(counts)
    at, of = found.ravel(), np.repeat(np.arange(len(found)), found.shape[1])
    of, at = of[at > 0], at[at > 0]
    goal = counts.astype(float).copy()
    goal[0] = 0.0
    uses = np.bincount(at, minlength=n).astype(float)
    # A pattern's own step: its row of |A'A| summed, which bounds A'A from above by a diagonal.
    weight = (np.arange(n) / (n - 1)) ** 2  # an error counts by its tokens: short pieces fill gaps later
    step = 1.0 / np.bincount(of, weights=weight[at] * uses[at], minlength=len(found))
    x = np.zeros(len(found))
    y, t = x, 1.0
    for _ in range(rounds):
        error = weight * (np.bincount(at, weights=y[of], minlength=n) - goal)
        new = np.maximum(0.0, y - step * np.bincount(of, weights=error[at], minlength=len(found)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def best_fit_counts(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on a histogram: patterns and repeats; equal open sequences move as one."""
    opened: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in opened if r >= n), default=None)
            if room is None:
                each = min(length // n, left)
                pattern, k = (n,) * each, left // each
                left -= k * each
                opened.setdefault(length - each * n, {})
                opened[length - each * n][pattern] = opened[length - each * n].get(pattern, 0) + k
                continue
            pattern = next(iter(opened[room]))
            have = opened[room][pattern]
            each = min(room // n, left)
            k = min(have, left // each)
            left -= k * each
            if k == have:
                del opened[room][pattern]
                if not opened[room]:
                    del opened[room]
            else:
                opened[room][pattern] = have - k
            new = pattern + (n,) * each
            rest = opened.setdefault(room - each * n, {})
            rest[new] = rest.get(new, 0) + k
    return [(p, k) for by in opened.values() for p, k in by.items()]


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and their repeats that hold every piece of the histogram once."""
    have = np.zeros(length + 1, dtype=np.int64)
    for n, k in counts.items():
        have[n] = k
    out = [((length,), int(have[length]))] if have[length] else []
    left = have.copy()
    left[length] = 0
    found = patterns(left, length)
    if len(found):
        repeats = np.floor(fit_counts(found, left) + 1e-9).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if not repeats[i]:
                break
            lengths, uses = np.unique(found[i][found[i] > 0], return_counts=True)
            k = int(min(repeats[i], (left[lengths] // uses).min()))
            if k:
                left[lengths] -= k * uses
                out.append((tuple(int(x) for x in found[i] if x), k))
    return out + best_fit_counts({int(n): int(left[n]) for n in np.flatnonzero(left)}, length)


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, k in planned:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + k
            offset += n
        sequence += k
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """``pieces`` (key, piece, length, ...) with ``sequence_id`` and ``offset``."""
    held = cut(pieces)
    counts = {int(r["length"]): int(r["n"]) for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = held.sparkSession.sparkContext.broadcast(_slots(plan(counts, length)))
    cells = min(MAX_CELLS, max(1, -(-sum(counts.values()) // CELL_ROWS)))
    salted = held.withColumn("_cell", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    sizes = salted.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_cell").orderBy(F.col(key), "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(firsts, ["length", "_cell"])

    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        table = slots.value
        keys = (table[:, 0] << 45) + table[:, 1]
        n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.searchsorted(keys, (n << 45) + r, side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 2] + r - table[at, 1], "offset": table[at, 3]})

    place = F.pandas_udf(placed, T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    out = ranked.withColumn("_at", place(F.col("length"), F.col("_first") + F.col("_rank")))
    return out.select(*[F.col(f"`{c}`") for c in pieces.columns], "_at.sequence_id", "_at.offset")


def packed_documents(docs: DataFrame) -> DataFrame:
    """The query's rows: every document's pieces and their places."""
    return pack(token_pieces(docs))
