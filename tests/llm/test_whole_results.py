"""Whole results of queries without SQL, rebuilt by plain loops over the fitted parameters or the drawn numbers."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from learntrace.llm import quality_fm, queries, sharding, toxicity_cnn
from tests.conftest import SF
from tests.llm.data import awkward


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def logistic(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_quality_scores_of_all_documents(spark):
    """Pairs of features one by one instead of the sum-of-squares identity."""
    docs = documents(spark).unionByName(awkward(spark).select("doc_id", "text"))
    machine = quality_fm.train(documents(spark), labels(spark))
    got = quality_fm.scored(docs, machine).select("text", "score").collect()
    assert len(got) == docs.count()
    for r in got:
        at, values = quality_fm.features(r["text"])
        x = values.astype(float)
        v = machine.factors[at].astype(np.float32).astype(float) * x[:, None]
        pairs = v @ v.T
        z = machine.bias + float((machine.weights[at].astype(np.float32) * x).sum()) + float(np.triu(pairs, 1).sum())
        assert abs(logistic(z) - r["score"]) < 1e-6
    whole = {r["doc_id"]: r for r in queries.QUERIES["op5_quality_classifier"](spark, SF).collect()}
    for r in quality_fm.scored(documents(spark), machine).collect():
        row = whole[r["doc_id"]]
        assert abs(row["score"] - r["score"]) < 1e-9 and row["predicted"] == (row["score"] >= 0.7) and row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def convolved(net, text):
    """The network's score by windows of words, one filter value after another."""
    words, _, language = toxicity_cnn.words_of(text)
    vectors = np.array([net.embedding[net.rows(np.array([toxicity_cnn.parts_of(w)]))[0]].astype(float).sum(axis=0) for w in words]).reshape(len(words), toxicity_cnn.DIM)
    z, at = float(net.bias), 0
    if words:
        for f in net.filters:
            padded = np.concatenate([vectors, np.zeros((len(f) - 1, toxicity_cnn.DIM))])
            windows = np.stack([padded[k : k + len(words)] for k in range(len(f))], axis=1)
            top = np.einsum("nwd,wdf->nf", windows, f.astype(float)).max(axis=0) + net.shifts[at : at + toxicity_cnn.FILTERS]
            z += float(np.maximum(top, 0) @ net.out[at : at + toxicity_cnn.FILTERS])
            at += toxicity_cnn.FILTERS
    return logistic(z - float(net.thresholds[language]))


def test_toxicity_scores_of_all_documents(spark):
    docs = documents(spark).unionByName(awkward(spark).select("doc_id", "text"))
    net = toxicity_cnn.train(documents(spark), labels(spark))
    got = toxicity_cnn.scored(docs, net).select("text", "score").collect()
    assert len(got) == docs.count()
    assert max(abs(convolved(net, r["text"]) - r["score"]) for r in got) < 1e-5  # products are kept in single precision
    whole = {r["doc_id"]: r for r in queries.QUERIES["op7_toxicity"](spark, SF).collect()}
    for r in toxicity_cnn.scored(documents(spark), net).collect():
        row = whole[r["doc_id"]]
        assert abs(row["score"] - r["score"]) < 1e-5 and row["predicted"] == (row["score"] >= 0.5) and row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_shards_and_slots_of_all_documents(spark):
    """The exchange rebuilt from the seed and the partitions: labels dealt by the drawn matrix, slots by the drawn numbers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "doc_id")
    held = docs.select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.octet_length("text").alias("n"), "text").orderBy("i").collect()
    parts = {}
    for r in held:
        parts.setdefault(r["p"], []).append(r)
    matrix = sharding.communication_matrix({p: len(rows) for p, rows in parts.items()}, sharding.SHARDS, sharding.SEED)
    drawn = {}
    for p, rows in parts.items():
        rng = np.random.default_rng([sharding.SEED, 1, p])
        shard = rng.permutation(np.repeat(np.arange(sharding.SHARDS), matrix[p]))
        key = rng.integers(0, 2**62, len(rows), dtype=np.int64)
        for at, r in enumerate(rows):
            drawn.setdefault(int(shard[at]), []).append((int(key[at]), (p << 40) + at, r))
    want = {}
    for shard, rows in drawn.items():
        for slot, (_, _, r) in enumerate(sorted(rows, key=lambda x: x[:2])):
            want[r["doc_id"]] = ((r["n"] or 0) + 16, zlib.crc32((r["text"] or "").encode()), "rows", shard, slot, None)
    got = {r["doc_id"]: tuple(r)[1:] for r in sharding.shard_digest(docs).collect()}
    assert got == want
    sizes = [len(rows) for rows in drawn.values()]
    assert len(sizes) == sharding.SHARDS and max(sizes) - min(sizes) <= 1
