"""run() against the same steps in plain Python."""

import re

import corpus_pipeline
from learntrace.llm import pii, simhash
from learntrace.llm.common import ROW
from tests.conftest import SF
from tests.llm.test_brute_force import measured, private
from tests.llm.test_near_copies import five_words


def test_run_keeps_what_plain_code_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        stages[name] = kept.toPandas()
    first = {r.doc_id: r.text for r in stages["quality_rules"].itertuples()}
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, t in whole.items():
        n, _, symbols, _, repeats = measured(t)
        if n < 20 or 100 * repeats > 30 * n:
            assert d not in first
        elif symbols == 0 and repeats == 0 and "!" not in t:
            assert d in first
    sets = {d: five_words(t) for d, t in first.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    second = set(stages["near_duplicates"]["doc_id"])
    assert second <= set(first)
    for d in set(first) - second:  # a document that went has a near copy
        assert any(alike(d, o) for o in first if o != d)
    for a in second:
        assert not any(a != b and alike(a, b) for b in second)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = {r.doc_id: r.text for r in stages["decontamination"].itertuples()}
    assert {d for d in second if any(i in whole[d] for i in items)} == second - set(third)
    for r in stages["pii"].itertuples():
        hidden = lambda t: private(t) or re.search('(?i)token = "[0-9a-f]{40}', t)
        if hidden(whole[r.doc_id]):
            assert r.text != whole[r.doc_id] and not hidden(r.text)
        else:
            assert r.text == whole[r.doc_id]
        assert r.n_chars == len(r.text)
    assert set(stages["packing"]["doc_id"]) == set(third)
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"])
    assert pii.KINDS[0].base


def test_near_copies_by_fingerprint_are_dropped(spark):
    """Texts within 2 bits whose five-word similarity is 0.57: the named method links them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (589, 6676, 3)")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    a, b = five_words(texts[589]), five_words(texts[6676])
    assert len(a & b) < 0.8 * len(a | b) and (simhash.fingerprint_of(texts[589]) ^ simhash.fingerprint_of(texts[6676])).bit_count() <= 2
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == {3, 589}


def test_links_of_both_kinds_make_one_group(spark):
    frame = lambda rows: spark.createDataFrame(rows, f"{ROW} long, root long")
    found = simhash.joined_groups(frame([(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)]), frame([(0, 0), (1, 2), (2, 2), (5, 5)])).collect()
    root = {r[ROW]: r["root"] for r in found}
    assert len(found) == 6 and root[0] == root[1] == root[2] and root[3] == root[4] != root[0] and root[5] == 5
