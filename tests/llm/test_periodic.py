"""Periodic runs against a walk over all periods."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from learntrace.llm import periodic, queries
from tests.conftest import SF
from tests.llm.data import awkward


def walked(w, words=24, repeats=3):
    """Runs by trying every period: stretches of equal words q apart whose smallest period is q."""
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(words, repeats * q) and all(any(w[s + k] != w[s + k + d] for k in range(n - d)) for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("words,repeats", [(24, 3), (10, 2), (7, 4), (2, 2)])
def test_runs_of_mixed_texts(words, repeats):
    draw = random.Random(words)
    for _ in range(60):
        texts = []
        for _ in range(draw.randint(1, 4)):
            w = []
            while len(w) < draw.randint(0, 140):
                if draw.random() < 0.5:
                    w += ([draw.choice("abxyz").encode() for _ in range(draw.randint(1, 9))] * draw.randint(1, 14))[: draw.randint(1, 60)]
                else:
                    w += [draw.choice("abcdefgh").encode() for _ in range(draw.randint(1, 10))]
            texts.append(w)
        assert periodic.runs_of(texts, words, repeats) == [walked(w, words, repeats) for w in texts]


def test_run_sizes_are_checked():
    with pytest.raises(ValueError):
        periodic.depth_of(24, 1)
    assert periodic.depth_of(24, 3) == 16


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = walked(w) if len(w) < 3000 else periodic.runs_of([w])[0]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == expected(r["doc_id"], texts[r["doc_id"]])
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = periodic.periodic_digest(docs).collect()
    want = sorted(str((d["doc_id"], *expected(d["doc_id"], d["text"]))) for d in docs.select("doc_id", "text").collect())
    assert sorted(str(tuple(r)) for r in got) == want
    assert periodic.periodic_digest(docs.limit(0)).count() == 0


def test_collapse_keeps_columns_and_other_texts(spark):
    docs = awkward(spark).unionByName(awkward(spark).limit(1).withColumn("text", F.lit("so " + "we go on " * 20 + "and end")).withColumn("doc_id", F.lit(77)))
    out = periodic.collapse_runs(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[77] == "so we go on and end" and texts[8] == "ab cd" and texts[7] == "x" * 200_000 and texts[4] == " \n\t "
    marked = periodic.periodic_runs(docs)
    assert marked.columns == [*docs.columns, "periodic"]
    assert {tuple(r) for r in marked.select("score", "_key").collect()} == {("kept as it is",) * 2}
