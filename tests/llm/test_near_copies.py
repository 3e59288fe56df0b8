"""The near-duplicate stage against all pairs, and rows whose ids are null or repeated."""

import itertools

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from learntrace.llm import decontam, minhash, simhash
from tests.llm.data import CLEAN

BIG = "/root/testdata/sf0.01"


def five_words(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def test_stage_links_what_all_pairs_link(spark):
    docs = pd.read_parquet(f"{BIG}/documents.parquet")
    sets = {d: five_words(t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            up[max(find(a), find(b))] = min(find(a), find(b))
    left = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{BIG}/documents.parquet"), BIG)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({find(d) for d in sets})


def test_rows_with_null_or_repeated_ids_are_judged_alone(spark):
    other = " ".join(CLEAN.split()[::-1])
    texts = [(1, CLEAN), (None, CLEAN), (None, "a text of its own that nothing else holds at all"), (None, other), (2, CLEAN), (2, "another text of its own under a repeated id"), (3, "words one two three four five"), (3, "quite different words stand in here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    unique = {t for _, t in texts}
    for kept in (simhash.drop_near_duplicates(docs), simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)):
        left = [tuple(r) for r in kept.collect()]
        assert len(left) == len(unique) and {t for _, t in left} == unique and (1, CLEAN) in left
    bench = spark.createDataFrame([(1, CLEAN)], "item_id long, text string")
    left = sorted((str(d), t) for d, t in decontam.decontaminated(docs, bench).collect())
    assert left == sorted((str(d), t) for d, t in texts if t != CLEAN)


def variants(rng, n, words=150):
    """Copies of one text with a few to many of its words changed, and some of their own."""
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base[: words - int(rng.integers(0, 30))])
        for at in rng.choice(len(text), int(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])), replace=False):
            text[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(text))
    return out


def test_variants_of_one_text_link_as_all_pairs_do(spark):
    """A crowded group whose pairs lie on both sides of the similarity."""
    rng = np.random.default_rng(5)
    texts = variants(rng, 150) + variants(rng, 60, 40) + ["", None, "one two"]
    sets = [five_words(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]]
    for a, b in near:
        up[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i in range(len(texts))}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["root"] for r in minhash.groups(rows, "id", "text", 5, 0.8).collect()}
    same = lambda m: {frozenset(i for i in m if m[i] == r) for r in m.values()}
    assert same(got) == same(want)
    # Across components nothing is left out, and little else is met.
    alone = spark.createDataFrame([(i, i) for i in range(210)], "node long, root long")
    met = {tuple(sorted(r)) for r in minhash._across(alone, rows.withColumnRenamed("id", "node"), 5, 0.8).collect()}
    assert {p for p in near if p[1] < 210} <= met and len(met) < 210 * 209 / 4


def test_bands_follow_the_similarity(spark):
    assert [minhash.band_rows(s) for s in (0.8, 0.5, 0.1, 1.0)] == [5, 2, 1, 160]
    for s in (0.01, 0.0, 1.5):
        with pytest.raises(ValueError):
            minhash.band_rows(s)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4000)]
    base = [[words[j] for j in rng.integers(0, 4000, 120)] for _ in range(40)]
    near = [b[:80] + [words[j] for j in rng.integers(0, 4000, 40)] for b in base]  # two thirds of the text: similarity about 0.5
    texts = [" ".join(t) for t in base + near]
    sets = [minhash.shingles(t, 5) for t in texts]
    alike = [minhash.jaccard(sets[i], sets[40 + i]) >= 0.45 for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(docs, shingle=5, similarity=0.45).collect()}
    assert sum(alike) > 20 and left == set(range(40)) | {40 + i for i in range(40) if not alike[i]}
