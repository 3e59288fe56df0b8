"""Near copies by Jaccard similarity of word shingles: MinHash bands propose, the shingle sets confirm.

A row's 160 minima form bands of as many rows as keep the chance that a pair of the similarity shares no band within
``MISS``: 32 bands of five at 0.8 (3e-6), 80 of two at 0.5. Rows that share a band are candidates. Equal sets are collapsed first. Candidates of a
band are compared with one of their own. Where that leaves a band more than one component, they are compared with
the rows of the two largest that most are linked to, and then across components by their rarest shingles, which leaves out no pair of the similarity and meets few others, so many
variants of one text cost little. Links are decided on the shingles themselves.

Defined results: a text of fewer words than a shingle is one shingle; null and wordless texts have
equal (empty) sets and are linked; repeated rows are equal sets; texts are read whole, their minima in bounded
memory; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learntrace.llm.common import small_side
from learntrace.llm.components import components
from learntrace.session import stored

SEED = 42
MINIMA = 160
MISS = 1e-5  # chance that a pair at the similarity shares no band
CHUNK = 4096  # shingles hashed at once
BUCKET = 1.05  # ratio of the sizes of sets that meet
_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(SEED + 1).integers(0, 2**64, MINIMA, dtype=np.uint64)
_MARKS = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def band_rows(similarity: float) -> int:
    """The most rows of a band that keep the chance of a miss; a ValueError where the minima do not reach the similarity."""
    fit = [r for r in range(1, MINIMA + 1) if (1 - similarity**r) ** (MINIMA // r) <= MISS]
    if not fit or not 0 < similarity <= 1:
        raise ValueError(f"{MINIMA} minima do not reach pairs of similarity {similarity}")
    return max(fit)


def shingles(text: str | None, shingle: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    k = min(shingle, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard(one: set[bytes], two: set[bytes]) -> float:
    both = len(one & two)
    return both / (len(one) + len(two) - both) if one or two else 1.0


def marks_of(text: str | None, shingle: int, rows: int) -> tuple[bytes, int, list[int]]:
    """Digest and size of the set of shingles, and a hash of each band."""
    h = np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, shingle)], dtype=np.uint64))
    least = np.full(MINIMA, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(h), CHUNK):  # bounded memory for very long texts
        np.minimum(least, (_FACTORS[:, None] * h[at : at + CHUNK] + _SHIFTS[:, None]).min(axis=1), out=least)
    bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least[: MINIMA // rows * rows].reshape(-1, rows))]
    return xxhash.xxh128_digest(h.tobytes()), len(h), np.array(bands, dtype=np.uint64).view(np.int64).tolist()


def marks(text: Column, shingle: int, rows: int) -> Column:
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marks_of(t, shingle, rows) for t in texts], columns=["sig", "n", "bands"])

    told.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(told, _MARKS)(text)


def _alike(shingle: int, similarity: float, a: str, b: str) -> Column:
    def told(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([jaccard(shingles(x, shingle), shingles(y, shingle)) >= similarity for x, y in zip(one, two, strict=True)], dtype=bool)

    told.__annotations__ = {"one": pd.Series, "two": pd.Series, "return": pd.Series}
    return F.pandas_udf(told, T.BooleanType())(F.col(a), F.col(b))


def _confirmed(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose texts are alike. Only candidates' texts are shuffled."""
    pairs = stored(pairs.select("a", "b").distinct())
    ids = small_side(stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    texts = stored(rows.join(ids, "node", "left_semi"))
    side = lambda x, t: texts.select(F.col("node").alias(x), F.col("text").alias(t)).hint("merge")  # noqa: E731  (texts never go over the driver)
    both = pairs.join(side("a", "_one"), "a").join(side("b", "_two"), "b")
    return stored(both.where(_alike(shingle, similarity, "_one", "_two")).select("a", "b"))


def hashed(text: Column, shingle: int) -> Column:
    """The hashes of a text's set of shingles."""
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(t, shingle)], dtype=np.uint64)).view(np.int64) for t in texts])

    told.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(told, T.ArrayType(T.LongType()))(text)


def _across(nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """All pairs ``a``, ``b`` of nodes (node, root) of different roots that can reach the similarity, by their rarest
    shingles; no pair that reaches it is left out.

    Shingles stand in one order, rare ones first. A pair that shares a shingle with i before it in one set of n and j in the
    other of m, and none before those, shares at most min(n - i, m - j), and needs s (n + m) / (1 + s). So the shorter set
    brings its first shingles down to a place that leaves 2 s n / (1 + s), and the longer one meets shorter sets of a size that
    its place still leaves room for; sizes are met by buckets. Of a shingle's sets those of its largest root do not
    meet one another, so a large group that is linked already costs only what others ask of it."""
    need, eps = similarity / (1 + similarity), 1e-6
    sets = stored(rows.join(small_side(nodes), "node").select("node", "root", hashed(F.col("text"), shingle).alias("h")))
    tokens = sets.select("node", "root", F.size("h").alias("n"), F.explode("h").alias("t"))
    held = tokens.groupBy("t", "root").agg(F.count("*").alias("c"))
    known = held.groupBy("t").agg(F.sum("c").alias("c"), F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("major"))
    placed = tokens.join(known.hint("merge"), "t").withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("c", "t")) - 1)
    placed = placed.where((F.col("n") - F.col("i") >= similarity * F.col("n") - eps) & (F.col("roots") > 1))
    bucket = lambda n: F.floor(F.log(n) / np.log(BUCKET) + 1e-9).cast("int")
    own = stored(placed.select("t", "node", "root", "n", "i", (F.col("root") != F.col("major")).alias("minor")))
    short = own.where(F.col("n") - F.col("i") >= 2 * need * F.col("n") - eps).withColumn("size", bucket(F.col("n")))
    most = F.least(F.col("n"), (F.col("n") - F.col("i")) / need - F.col("n") + eps)
    long = own.withColumn("size", F.explode(F.sequence(bucket(F.greatest(similarity * F.col("n") - eps, F.lit(1.0))), bucket(F.greatest(most, F.lit(1.0))))))
    long = long.select("t", "size", F.col("node").alias("other"), F.col("root").alias("root2"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("minor").alias("minor2"))
    room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need * (F.col("n") + F.col("m")) - eps

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        both = one.join(two.hint("merge"), ["t", "size"]).where((F.col("root") != F.col("root2")) & (F.col("n") <= F.col("m")) & room)
        return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    return met(short.where("minor"), long).union(met(short.where("not minor"), long.where("minor2")))


def groups(rows: DataFrame, row: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """``row`` and ``root`` (a row of its component) for checkpointed rows with distinct ids ``row``."""
    rows = rows.select(F.col(row).alias("node"), F.col(text).alias("text"))
    marked = stored(rows.select("node", marks(F.col("text"), shingle, band_rows(similarity)).alias("m")).select("node", "m.*"))
    firsts = stored(marked.groupBy("sig").agg(F.min(F.struct("node", "n", "bands")).alias("f")).select("sig", "f.*"))
    placed = firsts.select("node", "n", F.explode("bands").alias("band"))
    # A band's centre is drawn by a hash of row and band, so that a row meets other centres in other bands.
    drawn = F.struct(F.xxhash64("node", "band").alias("k"), F.col("node").alias("other"), F.col("n").alias("m"))
    tops = placed.groupBy("band").agg(F.count("*").alias("held"), F.min(drawn).alias("top"))
    crowded = stored(placed.join(tops.where("held > 1").hint("merge"), "band"))
    fit = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6
    centred = crowded.select("node", "n", "top.*").where((F.col("node") != F.col("other")) & fit)
    links = _confirmed(centred.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), rows, shingle, similarity)
    roots = components(links)

    def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of bands of three or more with their roots, and the bands among these that hold more than one."""
        many = crowded.where("held > 2").join(found.hint("merge"), "node", "left").select("node", "n", "band", F.coalesce("root", "node").alias("root"))
        return many, many.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")

    # Bands of two are judged. In larger ones that hold more than one component, all others meet the rows that most are
    # linked to of the two largest,
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    many, bands = split(roots)
    many = stored(many.join(bands.hint("merge"), "band", "left_semi").join(degrees.hint("merge"), "node", "left").na.fill(0, ["d"]))
    best = stored(many.groupBy("band", "root").agg(F.struct(F.count("*").alias("c"), F.max(F.struct("d", F.col("node").alias("other"), F.col("n").alias("m"))).alias("h"), F.col("root")).alias("best")))
    first = best.groupBy("band").agg(F.max("best").alias("best"))
    rest = best.join(first.select("band", F.col("best.root").alias("largest")).hint("merge"), "band").where("root <> largest")
    hubs = first.unionByName(rest.groupBy("band").agg(F.max("best").alias("best"))).select("band", F.col("best.root").alias("root2"), "best.h.other", "best.h.m")
    met = many.join(hubs.hint("merge"), "band").where((F.col("root") != F.col("root2")) & fit)
    if not many.isEmpty():
        more = _confirmed(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), rows, shingle, similarity)
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
        # and what is apart still is compared across components.
        many, bands = split(roots)
        nodes = stored(many.join(bands.hint("merge"), "band", "left_semi").groupBy("node").agg(F.min("root").alias("root")))
        more = _confirmed(_across(nodes, rows, shingle, similarity), rows, shingle, similarity)
        if not more.isEmpty():
            roots = components(links.union(more))
    named = firsts.join(roots.hint("merge"), "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
    return marked.select(F.col("node").alias(row), "sig").join(named.hint("merge"), "sig").select(row, "root")
