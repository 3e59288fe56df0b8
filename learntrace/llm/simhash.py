"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: the (63, 57) Hamming code on bits 0 to 62, times both
values of bit 63. Its covering radius is 1, so every point has an anchor within 1. Two fingerprints
at distance 2 or less have a point within 1 of both, and that point's anchor lies within
1 + 1 = 2 of both: the covering radius plus each side's half of the threshold. So each distinct
fingerprint goes to every anchor within 2 (33 of them, 2 if it is a code word), and fingerprints
are compared per anchor. An anchor has at most 2,081 distinct fingerprints within 2, so a group is
bounded whatever the input, and the 2^58 anchors keep groups small at any number of documents.

Defined results: a null or empty text has no words and fingerprint 0, linked like any other;
repeated rows share fingerprint and component; a null doc_id is never a component's name unless all
its members are null; texts are read whole, their shingles in bounded memory; a bit that exactly half of the shingles have is 0;
of a component whose smallest keys tie one row stays; an empty table gives an empty table; other columns, whatever their names, are not looked at or stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learntrace.llm import minhash
from learntrace.llm.common import ROW, numbered, without_ids
from learntrace.llm.components import components
from learntrace.session import stored

SEED = 42
SHINGLE = 3
THRESHOLD = 2
CODE_BITS = 63
FLUSH = 500_000  # linked fingerprints that a task holds before it writes its forest


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint: majority of the XXH64 bits of the text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-1].tolist())]
    stops = (ends - 1).tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[i:j], SEED) for i, j in zip(starts, stops[k - 1 :], strict=False)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column | str, shingle: int = SHINGLE) -> Column:
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    told.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(told, T.LongType())(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchors(fp: Column) -> Column:
    """Array of the anchors within 2 of a fingerprint.

    The syndrome names the one flip that reaches the code, or the pairs of flips i, j with
    i xor j = syndrome; flipping bit 63 leaves one more flip."""
    masks = [_signed(sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> k & 1)) for k in range(6)]
    syndrome = sum((F.bit_count(fp.bitwiseAND(F.lit(m))) % 2 * (1 << k) for k, m in enumerate(masks)), F.lit(0))

    def flips(s: int) -> list[int]:
        one = 1 << (s - 1) if s else 0
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, CODE_BITS + 1) if s and i < i ^ s]
        return [_signed(x) for x in (one, one | 1 << 63, *pairs)]

    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in flips(s)]) for s in range(64)])
    return F.transform(F.get(table, syndrome), lambda m: m.bitwiseXOR(fp))


class _Forest:
    """Union-find over fingerprints; ``edges`` is a spanning forest of all links seen."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def link(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def flush(self) -> pa.RecordBatch:
        pairs = [(n, self.find(n)) for n in list(self.up)]
        pairs = [(n, r) for n, r in pairs if n != r]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], threshold: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """From rows (anchor, fp) sorted by anchor: a spanning forest of the pairs within the threshold."""
    forest = _Forest()
    rest = np.empty((0, 2), dtype=np.int64)

    def group(anchor: np.ndarray, fp: np.ndarray) -> None:
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(anchor)])
        two = first[size == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= threshold
        for i in two[near].tolist():
            forest.link(int(fp[i]), int(fp[i + 1]))
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = np.unique(fp[at : at + n])
            for i in range(len(own) - 1):
                for j in np.flatnonzero(np.bitwise_count((own[i + 1 :] ^ own[i]).view(np.uint64)) <= threshold).tolist():
                    forest.link(int(own[i]), int(own[i + 1 + j]))

    for batch in batches:
        rows = np.column_stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
        rows = np.concatenate([rest, rows])
        if not len(rows):
            continue
        whole = np.flatnonzero(rows[:, 0] != rows[-1, 0])
        upto = whole[-1] + 1 if len(whole) else 0
        if upto:
            group(rows[:upto, 0], rows[:upto, 1])
        rest = rows[upto:]
        if len(forest.up) > FLUSH:
            yield forest.flush()
    if len(rest):
        group(rest[:, 0], rest[:, 1])
    yield forest.flush()


def links(fps: DataFrame, fp: str = "fp", threshold: int = THRESHOLD) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints of ``fps``: not every pair within the
    threshold, but enough that linked fingerprints stay connected. The anchors reach no threshold above 2."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors reach thresholds from 0 to {THRESHOLD}, not {threshold}")
    placed = fps.select(F.explode(anchors(F.col(fp))).alias("anchor"), F.col(fp).alias("fp"))
    dealt = placed.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(lambda batches: _linked(batches, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``key``, ``fp`` (long) and ``component_id``, the smallest key reachable over links."""
    marked = stored(docs.select(F.col(key).alias(key), fingerprint(F.col(text), shingle).alias("fp")))
    distinct = stored(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct, threshold=threshold))
    named = stored(distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(best.hint("merge"), "root").select("fp", "component_id")
    return marked.join(by_fp.hint("merge"), "fp", "left").select(key, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key. Rows are linked and dropped one
    by one: those with a null or repeated key go only if their own text is linked.

    Rows are linked if their fingerprints lie within ``threshold``. With ``similarity``, those of three-word shingles are linked
    that way, and further rows if the Jaccard similarity of their sets of ``shingle`` words reaches it (over MinHash
    bands): the anchors reach 2 bits only. Links of both kinds make one component."""
    rows = numbered(docs)
    groups = near_duplicates(rows, text, ROW, shingle if similarity is None else SHINGLE, threshold).withColumnRenamed("component_id", "root")
    if similarity is not None:
        groups = joined_groups(groups, minhash.groups(rows, ROW, text, shingle, similarity))
    return _one_of_each(rows, groups, key)


def joined_groups(groups: DataFrame, more: DataFrame) -> DataFrame:
    """ROW and ``root`` of the groups that two groupings of numbered rows make together; a row may be in one only.

    Only groups of several rows are linked, each row to the root that names its group, so links are as many as such rows."""
    both = stored(groups.select(ROW, "root").unionByName(more.select(ROW, "root")).where(F.col("root").isNotNull()))
    links = both.where(F.col(ROW) != F.col("root")).select(F.col(ROW).alias("a"), F.col("root").alias("b"))
    roots = components(links)
    named = both.select(ROW).distinct().join(roots.hint("merge"), F.col(ROW) == F.col("node"), "left")
    return named.select(ROW, F.coalesce("root", F.col(ROW)).alias("root"))


def _one_of_each(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Numbered rows without those that share a ``root`` with one of a smaller key (null is the greatest)
    or, of the same key, of a smaller number."""
    order = F.struct(F.col("_lt_key").isNull(), F.col("_lt_key"), F.col(ROW).alias("first"))
    told = stored(groups.select(ROW, "root").join(rows.select(ROW, F.col(key).alias("_lt_key")).hint("merge"), ROW))
    best = told.groupBy("root").agg(F.min(order).alias("b"), F.count("*").alias("n")).where("n > 1").select("root", "b.first")
    return without_ids(rows, told.join(best.hint("merge"), "root").where(F.col(ROW) != F.col("first")), ROW).drop(ROW)


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: the fingerprint as 16 lowercase hex digits and the component."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
