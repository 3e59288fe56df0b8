"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its first two occurrences,
suffixes q words apart, share all words but the first q of the run, so a run of at least ``repeats`` periods and
``words`` words shows as two suffixes with a common prefix of at least ``depth`` words. For each batch of texts

1. a rolling hash finds the texts in which some ``depth`` words recur (equal words have equal hashes, so none is missed);
2. suffixes of those texts are sorted by prefix doubling, only ties being sorted on (a doubling keeps its ranks, and
   the ranks give the common prefixes of neighbours from the longest doubling down);
3. neighbours are united in the order of decreasing common prefix, as Kruskal does: each class of suffixes keeps its
   positions in order, the smaller class is put into the larger one, and two positions that become neighbours there at a
   distance within the common prefix seed a run. Of the many seeds of a run only that without an equal word before it counts,
   and it spans the run: it starts with its first position, and ends where the common prefix does. A multiple of the
   smallest period never seeds, for the position one period on lies between by then.

Texts are independent, so they are scored where they lie, without a shuffle. A text's memory is some tens of bytes a word.

Defined results: a null or empty text has no words and no runs; texts are taken whole, however long; repeated rows and
repeated or null keys are rows like any other; runs may overlap and come by start, then period; an empty table gives an
empty table; columns of any names but that of the result are carried along.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.llm.common import columns, whole_text

WORDS, REPEATS = 24, 3
BATCH_WORDS = 200_000  # words that are taken together; a longer text makes a batch of its own
PERIODIC = "struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def words_of(text: str | None) -> list[bytes]:
    """Words, parted by ASCII white space."""
    return (text or "").encode("utf-8", "replace").split()


def depth_of(words: int = WORDS, repeats: int = REPEATS) -> int:
    """The greatest power of two within the words that the first two occurrences of any run share."""
    if words < 2 or repeats < 2:
        raise ValueError("a run has two words and two periods at least")
    least = min(max(words, repeats * q) - q for q in range(1, words + 1))
    return 1 << (least.bit_length() - 1)


def _recurring(ids: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """Documents in which some ``depth`` words may occur twice: all that do, by their hashes."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while size < depth:
        if len(h) <= size:
            return np.empty(0, dtype=np.int64)
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    mask = np.uint64((1 << int(doc[-1]).bit_length()) - 1)
    keyed = np.sort((h & ~mask) | doc[: len(h)].astype(np.uint64))
    return np.unique(keyed[1:][keyed[1:] == keyed[:-1]] & mask).astype(np.int64)


def _sorted_suffixes(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, documents apart, and the ranks of their first 1, 2, 4, ... words. Each document ends with an
    id of its own, so a suffix that reaches it is alone and needs no further words."""
    n = len(ids)
    key = doc.astype(np.int64) << 32 | ids
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, size = [rank.astype(np.int32)], 1
    tied = order[~(new & np.r_[new[1:], True])]
    while len(tied):
        key = rank[tied] * n + rank[tied + size]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        first = np.r_[True, old[1:] != old[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        start_old, start_new = np.flatnonzero(first)[np.cumsum(first) - 1], np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[tied] = old + start_new - start_old
        levels.append(rank.astype(np.int32))
        tied = tied[~(new & np.r_[new[1:], True])]
        size *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def _neighbours(suffixes: np.ndarray, levels: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order whose suffix shares ``depth`` words or more with the one before, by decreasing number."""
    level = depth.bit_length() - 1
    if level >= len(levels):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.flatnonzero(levels[level][suffixes[1:]] == levels[level][suffixes[:-1]]) + 1
    a, b = suffixes[at - 1], suffixes[at]
    shared = np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += (levels[k][a + shared] == levels[k][b + shared]).astype(np.int64) << k
    by = np.argsort(-shared, kind="stable")
    return at[by], shared[by]


def _kruskal(ids: list[int], suffixes: np.ndarray, at: np.ndarray, shared: np.ndarray, words: int, repeats: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from uniting the classes of neighbouring suffixes by decreasing common prefix."""
    place = suffixes.tolist()
    up: dict[int, int] = {}
    positions: dict[int, list[int]] = {}
    runs: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up[x]
        return root

    def seed(i: int, j: int, same: int) -> None:
        if (repeats - 1) * (j - i) <= same and j - i + same >= words and ids[i - 1] != ids[j - 1]:
            runs.append((i, j - i + same, j - i))

    for k, same in zip(at.tolist(), shared.tolist(), strict=True):
        x, y = find(k - 1), find(k)
        into, small = positions.pop(x, None) or [place[x]], positions.pop(y, None) or [place[y]]
        if len(into) < len(small):
            into, small, x, y = small, into, y, x
        last = len(small) - 1
        for t, b in enumerate(small):
            i = bisect_left(into, b)
            if i and (t == 0 or small[t - 1] < into[i - 1]):
                seed(into[i - 1], b, same)
            if i < len(into) and (t == last or small[t + 1] > into[i]):
                seed(b, into[i], same)
        if len(small) * 8 < len(into):
            for b in small:
                insort(into, b)
        else:
            into += small
            into.sort()
        up[y], positions[x] = x, into
    return runs


def runs_of(texts: list[list[bytes]], words: int = WORDS, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    depth = depth_of(words, repeats)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    if not len(ids):
        return found
    firsts = np.cumsum(sizes) - sizes
    chosen = _recurring(ids, np.repeat(np.arange(len(texts)), sizes), depth)
    if not len(chosen):
        return found
    ends = len(number)
    parts = [np.r_[ids[firsts[d] : firsts[d] + sizes[d]], ends + i] for i, d in enumerate(chosen.tolist())]
    starts = np.cumsum([0] + [len(p) for p in parts])
    joined = np.concatenate(parts)
    suffixes, levels = _sorted_suffixes(joined, np.repeat(np.arange(len(parts)), np.diff(starts)))
    at, shared = _neighbours(suffixes, levels, depth)
    for start, length, period in _kruskal(joined.tolist(), suffixes, at, shared, words, repeats):
        i = int(np.searchsorted(starts, start, "right")) - 1
        found[chosen[i]].append((start - int(starts[i]), length, period))
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by a space, without those that a run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        kept = (np.cumsum(gone[:-1]) == 0).tolist()
        words = [w for w, k in zip(words, kept, strict=True) if k]
    return b" ".join(words).decode("utf-8", "replace")


def find_runs(text: Column | str, words: int = WORDS, repeats: int = REPEATS) -> Column:
    """``runs`` and the ``collapsed`` text of each text."""
    def told(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        held: list[list[bytes]] = []
        size = 0

        def flush() -> None:
            rows.extend(([{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed(w, runs)) for w, runs in zip(held, runs_of(held, words, repeats), strict=True))
            held.clear()

        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                flush()
                size = 0
        flush()
        return pd.DataFrame(rows, columns=["runs", "collapsed"])

    told.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(told, PERIODIC)(text)


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "periodic", words: int = WORDS, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with a column ``out``: the runs of at least ``words`` words and ``repeats`` periods, and the collapsed text."""
    return docs.select(*columns(docs, out), find_runs(F.col(text), words, repeats).alias(out))


def collapse_runs(docs: DataFrame, text: str = "text", words: int = WORDS, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with the texts that hold runs replaced by their collapsed form; other texts stay as they are."""
    found = periodic_runs(docs, text, "_lt_periodic", words, repeats)
    new = F.when(F.size("_lt_periodic.runs") > 0, F.col("_lt_periodic.collapsed")).otherwise(F.col(text))
    return found.withColumn(text, new).drop("_lt_periodic").select(*columns(docs))


def best_run(runs: Column) -> Column:
    """The run of the greatest exact length by period; ties go to the smaller start, then period (null: no run)."""
    better = lambda best, r: best["start"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.struct(*[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(key: Column, text: Column) -> Column:
    """Texts with known runs: of about a tenth of the keys (null: as an empty text), words from some place on repeat with
    a period that the key's checksum draws. Other texts stay as they are."""
    def repeated(keys: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for key, text in zip(keys, texts, strict=True):
            h = zlib.crc32((key or "").encode())
            words = words_of(text) if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                period = words[a : a + p]
                text = b" ".join(words[:a] + (period * -(-(n - a) // p))[: n - a]).decode("utf-8", "replace")
            out.append(text)
        return pd.Series(out, dtype=object)

    repeated.__annotations__ = {"keys": pd.Series, "texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(repeated, "string")(key.cast("string"), text)


def periodic_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: the runs of the planted texts, the strongest of them and the digests."""
    rows = docs.select("doc_id", planted(F.col("doc_id"), whole_text()).alias("text"))
    found = periodic_runs(rows).select("doc_id", "periodic.runs", "periodic.collapsed").withColumn("best", best_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
