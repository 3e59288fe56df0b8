"""Every operator and stage on awkward rows and on empty tables."""

import pytest

import corpus_pipeline
from learntrace.llm import decontam, html_extract, license_scan, packing, pii, quality_fm, quality_rules, sharding, simhash, toxicity_cnn
from tests.conftest import SF
from tests.llm.data import CLEAN, awkward, plain_docs


def labels(spark, label):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (1, None)], f"doc_id long, {label} int")


def bench(spark):
    return spark.createDataFrame([(1, CLEAN), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


DIGESTS = {
    "op1": pii.pii_digest, "op2": quality_rules.quality_digest, "op3": lambda d: html_extract.page_digest(d.selectExpr("doc_id as page_id", "source as url", "text as html")), "op4": simhash.simhash_digest,
    "op5": lambda d: quality_fm.quality_scores(d, labels(d.sparkSession, "quality")), "op7": lambda d: toxicity_cnn.toxicity_scores(d, labels(d.sparkSession, "toxic")),
    "op8": license_scan.license_digest, "op9": sharding.shard_digest, "op10": packing.packed_documents,
}


@pytest.mark.parametrize("name", DIGESTS)
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    got = DIGESTS[name](docs).collect()
    assert len(got) >= docs.count() and (name == "op10" or len(got) == docs.count())
    score = [r["score"] for r in got if "score" in r.asDict()]
    assert all(0 <= s <= 1 for s in score)


@pytest.mark.parametrize("name", DIGESTS)
def test_empty_tables(spark, name):
    assert DIGESTS[name](awkward(spark).limit(0)).count() == 0


def test_models_without_labels_score_all_alike(spark):
    docs, none = plain_docs(spark), labels(spark, "quality").limit(0)
    assert {r["score"] for r in quality_fm.quality_scores(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity_cnn.toxicity_scores(docs, labels(spark, "toxic").limit(0)).collect()} == {0.5}


def test_leaks_of_awkward_rows(spark):
    docs = awkward(spark)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench(spark)).collect()} == {(1, 1), (6, 1), (10, 1)}
    assert decontam.leaks(docs, bench(spark).limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), bench(spark)).count() == 0
    left = decontam.decontaminated(docs, bench(spark))
    assert left.columns == docs.columns and left.count() == docs.count() - 4


def test_operators_keep_other_columns(spark):
    docs = awkward(spark)
    for df, out in ((pii.find_pii(docs), "pii"), (quality_rules.ledger(docs), "quality"), (license_scan.scan_licenses(docs), "license"), (pii.redact(docs), "text")):
        assert sorted(df.columns) == sorted(docs.columns)
        assert df.count() == docs.count()
        other = [c for c in ("score", "fp", "_key", "n_words") if c != out]
        assert {tuple(r) for r in df.select(*other).collect()} == {("kept as it is",) * len(other)}
    placed = sharding.assign(docs)
    assert sorted(placed.columns) == sorted(docs.columns) and placed.count() == docs.count()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = awkward(spark)
    out = stage(spark, docs, SF)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    out.collect()


def test_near_duplicates_keep_one_row_of_a_group(spark):
    left = simhash.drop_near_duplicates(plain_docs(spark))
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(1) == 1 and 6 not in ids and ids.count(None) == 1
    assert ids.count(2) == 1 and 3 not in ids and 4 not in ids  # texts without words have fingerprint 0
