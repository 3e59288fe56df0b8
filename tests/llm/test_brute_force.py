"""The queries against plain loops over whole tables, and their own properties."""

import collections
import hashlib
import html
import math
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from learntrace.llm import decontam, html_extract, learning, license_scan, packing, pii, quality_fm, quality_rules, queries, sharding, simhash, toxicity_cnn
from learntrace.llm.components import components
from tests.conftest import SF
from tests.llm.data import CLEAN, awkward

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    df = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(df["doc_id"], df["text"], strict=True))


def luhn(digits):
    return sum((d - 9 if d > 9 else d) for d in (int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1]))) % 10 == 0


def private(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    spans = []
    for order, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or "") if kind != "email" or "@" in (text or "") else ():
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


TRICKY = ["a@b.c.@d.e x", "1.2.3.45.6.7.8 000255.1.1.1 256.1.1.1", "4539578763621486 and 4539 5787 6362 1486-", "+1 (2) 3((((+49 151 123 456 7-", "x+1 999 999 999.9.9.9 5@a-.b", "é😀 foo@bar.com", "9" * 5000 + "a" * 5000, "@", "+", "1-2-3 4"]


def test_pii(spark, texts):
    rows = [*texts.items(), *((-i - 1, t) for i, t in enumerate(TRICKY))]
    for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = private(dict(rows)[r["doc_id"]])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == r["base_sha256"]
        assert set(want) <= set(r["spans"].split(",")) | {""}
        counts = collections.Counter(s.split(":")[0] for s in want)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [counts[k] for k in ("email", "ip", "card", "phone")]


def test_pii_checks_and_context(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 ok"), (2, "iban DE89 3704 0044 0532 0130 01 ok"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "mail me a@b.co"), (6, f"token = {'0a' * 20}!"), (7, f"digest {'0a' * 20}"), (8, f"token = {'0x' * 20}")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(df).collect()}
    assert got[1] == "iban:5:32" and "iban" not in got[2] and got[3] == "ssn:4:15" and got[4] == ""
    assert got[6] == "secret:8:48" and got[7] == "" and got[8] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] == "iban [IBAN] ok" and clean[4] == "part 123-45-6789" and clean[5] == "mail me [EMAIL]"


def test_pii_of_many_matches(spark):
    """Positions across blocks of the text and over many matches, and redaction by them."""
    spans = ["card 4539 5787 6362 1486-", "é😀 a{}@b.co,", "+49 151 {};", "1.2.3.4 é", "7 8 9,", "x" * 1500, "12 34 56 78 90 12 34 56 78 90 12 34,"]
    text = " ".join(spans[i % 7 if i % 70 else 5].format(1_000_000 + i) for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "a@b.co" * 500), (3, "x" * 1024 + "a@b.co"), (4, "a@b.co")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in pii.pii_digest(df).collect():
        assert r["spans"] == ",".join(private(rows[r["doc_id"]]))
    for r in pii.redact(df).collect():
        out, at = [], 0
        for kind, a, b in (s.split(":") for s in private(rows[r["doc_id"]])):
            if int(a) >= at:
                out += [rows[r["doc_id"]][at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        assert r["text"] == "".join([*out, rows[r["doc_id"]][at:]])


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts):
    docs = awkward(spark).select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {**{-r["doc_id"]: r["text"] for r in docs.collect()}, **texts}
    entries = quality_rules.ledger(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    for r in quality_rules.quality_digest(entries).collect():
        want = measured(rows[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    masks = [r[0] for r in entries.select("quality.failures").collect()]
    bits = quality_rules.mask_of(quality_rules.POLICIES["v2"])
    for r in quality_rules.ablation(entries, "v2").collect():
        one = 1 << r["bit"]
        assert r["failed"] == sum(bool(m & one) for m in masks) and r["failed_alone"] == sum(m & bits == one for m in masks) and r["kept_without"] == sum(not m & bits & ~one for m in masks)
    v1 = quality_rules.apply_policy(entries, "v1").where("kept").count()
    assert v1 >= quality_rules.apply_policy(entries, "v2").where("kept").count()


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_html(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")["html"]
    for r in queries.QUERIES["op3_html_extract"](spark, SF).collect():
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page,want",
    [
        ("plain words", "plain words"), ("<p>a &amp; b&nbsp;c<br>d</p><script>x()</script>", "a & b c d"), ("<nav>menu<article><h1>T</h1><p>One.</article>", "T\nOne."), ("<![bad x]><p>y", "<![bad x]>\ny"),
        ('<div class="cookie-notice">N</div><main><header><h1>T</h1></header><p>Long enough text here.</p><form>f</form><aside>s</aside></main><div id="comments"><article>c</article></div><footer>f</footer>', "T\nLong enough text here."),
    ],
)
def test_html_shapes(page, want):
    assert html_extract.main_text(page) == want


def test_smoothing_keeps_a_constant():
    assert np.allclose(html_extract.smoothed([2.0] * 9), 2.0) and html_extract.threshold([0, 0, 10, 10]) == 5


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs = dict(zip(docs["doc_id"], docs["text"], strict=True)) | {-1: None, -2: "", -3: "One two", -4: "one  TWO"}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_digest(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    fp = {i: fingerprint(t) for i, t in docs.items()}
    up = {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in docs}


def test_anchors_meet_at_distance_two_and_a_dense_group_is_whole(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)] + [0, 2**64 - 1]
    flips = [(a, b) for a in range(0, 64, 7) for b in range(63, 0, -9) if a != b]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = [(signed(x), signed(x ^ 1 << a ^ 1 << b)) for x in base for a, b in flips]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(~F.arrays_overlap(simhash.anchors(F.col("a")), simhash.anchors(F.col("b")))).isEmpty()
    ball = sorted({signed(77 ^ 1 << a ^ 1 << b) for a in range(64) for b in range(64)} | {signed(77 ^ 1 << a) for a in range(64)})
    roots = components(simhash.links(spark.createDataFrame([(x,) for x in ball], "fp long")))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(ball)


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = components(df)
    assert found.groupBy("root").count().select("count").orderBy("count").collect() == [(2,), (301,)]


def auc(scores, labels):
    ranks, ones = pd.Series(scores).rank().to_numpy(), labels.sum()
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def held(spark, name, label, folder):
    got = queries.QUERIES[name](spark, folder).toPandas()
    folds = {"quality": (4, 2), "toxic": (5, 0)}[label]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds[0] == folds[1] for i in got["doc_id"]]).all()
    rows = got.merge(pd.read_parquet(f"{folder}/labels.parquet"))
    return rows[rows["held_out"]]


def test_quality_on_held_out_rows(spark):
    rows = held(spark, "op5_quality_classifier", "quality", BIG)
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.97 and (rows["predicted"] == rows["quality"]).mean() > 0.95


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More labelled rows than a shard has: words that only three texts hold are known wherever they lie, all rows' labels make the
    thresholds, a key that comes twice counts once."""
    monkeypatch.setattr(toxicity_cnn, "LEAST_EPOCHS", 1)
    monkeypatch.setattr(toxicity_cnn, "EPOCH_ROWS", 1)
    word = lambda g: "".join("abcdefghij"[int(c)] for c in f"{g:05d}")
    docs = spark.createDataFrame([(i, f"z{word(i // 3)}z {'scoundrel' if i % 2 else 'gardener'}") for i in range(18_000)], "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id < 300").selectExpr("doc_id", "'zzonlytwice zzz' as text"))
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic").distinct()
    rows, n = toxicity_cnn.training_rows(docs, labels)
    seen = {r[0] for r in docs.where(learning.fold(F.col("doc_id"), 5) != 0).select("doc_id").distinct().collect()}
    assert n == len(seen) == rows.count() > 14_000 and rows.select("shard").distinct().count() == rows.rdd.getNumPartitions() == 2
    texts = {r["doc_id"]: r["text"] for r in docs.where("text not like '%zzonly%'").collect()}
    whole = [g for g in range(100, 6_000) if all(i in seen for i in (3 * g, 3 * g + 1, 3 * g + 2))]
    net = toxicity_cnn.fitted(rows, n)
    assert len(whole) > 2_000 and (net.rows(np.array([toxicity_cnn.parts_of(texts[3 * g].split()[0])[0] for g in whole])) > 0).all()
    got = toxicity_cnn.scored(docs.where("doc_id >= 300").sample(0.05, 1), net).select("doc_id", "score").collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got)


def test_toxicity_hashes_words_together_as_one_by_one():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgzéßñ字𐐀x0"), n)) for n in rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 30, 63, 64, 65, 200], 2_000)]
    assert (toxicity_cnn.parts_of_all(words) == np.array([toxicity_cnn.parts_of(w) for w in words])).all()
    assert toxicity_cnn.parts_of_all([]).shape == (0, 5)


def test_toxicity_workers_hold_few_texts_at_once():
    """A worker that lives on keeps no words of texts that it has encoded, and a batch of them is never held encoded as a whole."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(1_000))
    toxicity_cnn.encode(text(0))
    tracemalloc.start()
    try:
        for i in range(30):
            toxicity_cnn.encode(text(i))
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
        n = 2_000  # their parts take 40 MB
        batch = pa.RecordBatch.from_pydict({"shard": pa.array([0] * n, pa.int32()), "apart": [i % 4 == 0 for i in range(n)], "label": pa.array([i % 2 for i in range(n)], pa.int32()), "_text": [text(i % 50) for i in range(n)]})
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        seen = 0
        for made in toxicity_cnn._packed(batch):
            for t, apart, label, language in toxicity_cnn._rows(made):
                if seen % 97 == 0:
                    want, told = toxicity_cnn.encode(text(seen % 50))
                    assert (t.ids == want.ids).all() and (t.parts == want.parts).all() and (apart, label, language) == (seen % 4 == 0, seen % 2, told)
                seen += 1
        assert seen == n and tracemalloc.get_traced_memory()[1] - before < 30 << 20
    finally:
        tracemalloc.stop()


def test_toxicity_scores_while_its_cache_is_emptied(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [None, "", *[" ".join(f"word{k}" for k in rng.integers(0, 400, n)) for n in (1, 3, 300, 40, 90_000, 7, 7)]]
    net = toxicity_cnn._started(np.unique(toxicity_cnn.parts_of_all([f"word{k}" for k in range(0, 400, 2)])).astype(np.int32)[1:], 0.3, 1)
    want = [net.score(net.logit(net.products(t.parts), t.ids), code) for t, code in map(toxicity_cnn.encode, texts)]
    for known, together in ((1 << 17, 128), (20, 2), (1, 1)):
        monkeypatch.setattr(toxicity_cnn, "KNOWN_WORDS", known)
        monkeypatch.setattr(toxicity_cnn, "TEXTS", together)
        assert np.allclose(list(toxicity_cnn._Scorer(net).scores(iter(texts))), want, atol=1e-6)


def test_toxicity_on_held_out_rows(spark):
    rows = held(spark, "op7_toxicity", "toxic", "/root/testdata/sf0.1")  # smaller tables hold six toxic held-out rows
    clean = rows[rows["toxic"] == 0]
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.95 and (clean["predicted"] == 0).mean() > 0.97
    assert rows.loc[rows["toxic"] == 1, "predicted"].mean() > 0.85


def test_factorisation_identity():
    rng = np.random.default_rng(4)
    m = quality_fm.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    at, x = np.array([1, 5, 7, 2, 3]), rng.normal(size=5)
    pair = lambda idx: sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in idx for j in idx if i < j)
    want = [0.3 + m.weights[at[idx]] @ x[idx] + pair(idx) for idx in ([0, 1, 2], [3, 4])]
    assert np.allclose(m.raw(at, x, np.array([0, 3]))[0], want)


def test_pooling_against_plain_convolution(monkeypatch):
    rng = np.random.default_rng(5)
    net = toxicity_cnn.Cnn(np.arange(10, 60, dtype=np.int32), rng.normal(size=(51, 8)).astype(np.float32), [rng.normal(size=(w, 8, 8)).astype(np.float32) for w in (1, 2, 3)], rng.normal(size=24).astype(np.float32), rng.normal(size=24).astype(np.float32), 0.5)
    parts = np.array([[10 + i, 11 + i, -1, 10_000, -1] for i in range(40)], dtype=np.int32)
    vectors = np.vstack([[net.embedding[i + 1] + net.embedding[i + 2] + 3 * net.embedding[0] for i in range(40)], np.zeros((2, 8))])
    texts = [rng.integers(0, 40, n) for n in (30, 1, 2, 17)]
    long = [np.r_[t, 40, 40] for t in texts]  # zeros stand beyond the end
    want = [[max(sum(vectors[t[i + k]] @ f[k, :, c] for k in range(w)) for i in range(len(t) - 2)) for w, f in zip((1, 2, 3), net.filters, strict=True) for c in range(8)] for t in long] + net.shifts
    got, places = net.pooled(net.products(parts), np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(got, want, atol=1e-4) and (places >= 0).all() and (places < 50).all()
    monkeypatch.setattr(toxicity_cnn, "PIECE", 4)
    for t, w in zip(texts, want, strict=True):
        assert np.isclose(net.logit(net.products(parts), t), np.maximum(w, 0) @ net.out + 0.5, atol=1e-3)
    assert net.logit(net.products(parts), texts[0][:0]) == 0.5


def test_training_follows_the_gradient():
    """A step lowers the loss of its batch, and words decide that no class shares."""
    rng = np.random.default_rng(6)
    rows = [toxicity_cnn.encode(" ".join(rng.choice(["river", "stone", "winter", "bridge", "garden"], 30)) + (" scoundrels" if i % 3 == 0 else " gardeners"))[0] for i in range(240)]
    labels = np.array([float(i % 3 == 0) for i in range(240)])
    net = toxicity_cnn._fit(rows, labels, 12, 1)
    z = np.array([net.logit(net.products(t.parts), t.ids) for t in rows])
    assert z[labels == 1].min() > z[labels == 0].max()
    unseen = toxicity_cnn.encode("river stone scoundrelly")[0]  # known by its prefixes
    assert net.logit(net.products(unseen.parts), unseen.ids) > z[labels == 0].max()


def test_planted_leaks_are_found_and_no_other(spark):
    docs, bench = pd.read_parquet(f"{BIG}/documents.parquet"), pd.read_parquet(f"{BIG}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_decontamination"](spark, BIG).collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [(i, f" {plain(t)} ") for i, t in zip(bench["item_id"], bench["text"], strict=True)]
    want = {(d, i) for d, t in zip(docs["doc_id"], docs["text"], strict=True) for p in [f" {plain(t)} "] for i, b in items if b in p}
    assert got == want


def test_reparameterised_questions(spark):
    item = "If John has 3 apples and buys 5 more apples for 3 dollars, how many apples does John have in total now?"
    asks = {
        1: "Q. If Mary has 7 apples and buys 9 more apples for 7 dollars, how many apples does Mary have in total now? Ok", 2: "If Mary has 7 apples and buys 9 more apples for 8 dollars, how many apples does Bob have in total now?",
        3: item, 4: CLEAN, 5: item.replace("3", "12,000.5").replace("dollars", "euros"),
    }
    got = decontam.leaks(spark.createDataFrame(list(asks.items()), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {1, 3, 5}


def test_leaks_by_shuffle_equal_leaks_by_broadcast(spark, monkeypatch):
    args = (spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    want = sorted(decontam.leaks(*args).collect())
    monkeypatch.setattr(decontam, "small_side", lambda df, rows=0: df)
    assert sorted(decontam.leaks(*args).collect()) == want


def test_licenses(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    rows = texts | {-1: "CC-BY cc by; GNU General Public License", -2: "cc by cc by cc by nc"}
    for r in license_scan.license_digest(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), rows[r["doc_id"]]))
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(",")) | {""}


@pytest.mark.parametrize(
    "text,order",
    [("MIT", ["MIT"]), ("a OR b AND c", ["a", "b", "c", "AND", "OR"]), ("(a OR b) AND c WITH e", ["a", "b", "OR", "c", "e", "WITH", "AND"]), ("a OR", ["a"]), ("(a", None), ("a b", ["a"]), (")", None), ("", None), ("a WITH (b OR c)", ["a"]), ("(a OR b) WITH c", ["a", "b", "OR"])],
)
def test_shunting_yard(text, order):
    tokens, ok, _ = license_scan.read_expression(text)
    assert (license_scan.postfix(tokens) if ok else None) == order


def test_expressions():
    assert license_scan.evaluate("MIT OR GPL-3.0-only")[2] == 0 and license_scan.evaluate("MIT AND GPL-3.0-only")[2] == 2
    assert license_scan.evaluate("GPL-2.0-only WITH Classpath-exception-2.0")[1:] == (["gpl-2.0-only"], 1, True)


@pytest.mark.parametrize(
    "text,labels,kind,malformed",
    [
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "apache-2.0,mit", "permissive", 0), ("<!-- SPDX-License-Identifier: MIT -->", "mit", "permissive", 0), ("SPDX-License-Identifier: MIT and nothing more.", "mit", "permissive", 0),
        ("spdx-license-identifier: MIT.", "mit", "permissive", 0), ("SPDX-License-Identifier: GPL-2.0-only WITH (MIT OR X)", "gpl-2.0-only", "strong copyleft", 0), ("x /* SPDX-License-Identifier:MIT and (isc or LGPL-2.1+) */", "isc,lgpl-2.1+,mit", "permissive", 0),
        ("SPDX-License-Identifier: (MIT OR", "mit", "permissive", 1), ("SPDX-License-Identifier:\nMIT", "", None, 0), ("SPDX-License-Identifier: DocumentRef-a:LicenseRef-b AND MIT\nLicense-Expression: EPL-2.0", "documentref-a:licenseref-b,epl-2.0,mit", "unknown", 0),
        ("SPDX-License-Identifier: see LICENSE file", "", None, 0), ("SPDX-License-Identifier: the licence of the whole", "", None, 0), ("SPDX-License-Identifier: NONE\n", "", None, 0), ("SPDX-License-Identifier: (see the file)", "", None, 0),
        ("/* SPDX-License-Identifier: curl */\nmore", "curl", "unknown", 0), ("License-Expression: WTFPL\n", "wtfpl", "unknown", 0), ("SPDX-License-Identifier: Foo-1.0 is ours", "foo-1.0", "unknown", 0), ("SPDX-License-Identifier: MIT see LICENSE", "mit", "permissive", 0),
        ("ÄSPDX-LICENSE-Identifier: Apache-2.0", "apache-2.0", "permissive", 0),
    ],
)
def test_tags(text, labels, kind, malformed):
    got = license_scan.scan(text)
    assert (got["labels"], got["class"], got["malformed"]) == (labels, kind, malformed)


def descend(words, floor=0):
    """Precedence climbing over the words of a whole expression: its class and identifiers."""
    if words[0] == "(":
        words.pop(0)
        kind, ids = descend(words)
        words.pop(0)
    else:
        ids = {words.pop(0)}
        kind = license_scan.license_class(*ids)
        if words and words[0] == "WITH":
            del words[:2]
            kind = max(0, kind - 1) if kind in (1, 2) else kind
    for level, name, of in ((2, "AND", max), (1, "OR", min)):
        while level > floor and words and words[0] == name:
            words.pop(0)
            k, more = descend(words, level)
            kind, ids = of(kind, k), ids | more
    return kind, ids


def test_tagged_documents(spark, texts):
    """Texts of the table with expressions drawn from a grammar."""
    rng = np.random.default_rng(8)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "LGPL-2.1+", "MPL-2.0", "CC-BY-NC-4.0", "Odd-1.0"]

    def drawn(depth):
        pick = rng.integers(0, 5) if depth else 0
        if pick < 2:
            return [str(rng.choice(names)), *(["WITH", "An-exception-1.0"] if rng.random() < 0.2 else [])]
        if pick == 2:
            return ["(", *drawn(depth - 1), ")"]
        return [*drawn(depth - 1), str(rng.choice(["AND", "OR"])), *drawn(depth - 1)]

    rows, want = [], {}
    for i, t in enumerate(t for t in texts.values() if "icense" not in (t or "") and "opyright" not in (t or "")):
        words = drawn(3)
        cut = int(rng.integers(0, len(t) + 1))
        rows.append((i, f"{t[:cut]}\n# SPDX-License-Identifier: {' '.join(words)}\n{t[cut:]}"))
        kind, ids = descend(list(words))
        want[i] = (license_scan.CLASSES[kind], {x.lower() for x in ids})
    got = license_scan.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(want) > 100
    for r in got:
        kind, ids = want[r["doc_id"]]
        assert r["license_class"] == kind and ids <= set(r["labels"].split(",")) and r["score"] == 1.0


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    got = sharding.shard_digest(docs).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(got) == docs.count() and got["grown_shard"].isna().all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_matrix_margins_and_law():
    counts = {0: 10, 1: 0, 2: 33, 5: 7}
    m = sharding.communication_matrix(counts, 4, 1)
    assert all(m[p].sum() == n for p, n in counts.items())
    total = sum(m.values())
    assert total.max() - total.min() <= 1 and total.sum() == 50
    mean = np.mean([sharding.communication_matrix(counts, 4, s)[2] for s in range(400)], axis=0)
    assert np.allclose(mean, 33 / 4, atol=0.3)


@pytest.mark.parametrize("good,bad,n", [(5, 7, 4), (40, 3, 41), (300, 500, 200), (1, 9, 3), (6, 6, 12)])
def test_draws_beyond_the_bound_are_exact(good, bad, n, monkeypatch):
    first, p = sharding._probabilities(good, bad, n)
    want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(first, first + len(p))]
    assert np.allclose(p, want, rtol=1e-9, atol=1e-18) and abs(sum(want) - 1) < 1e-9
    monkeypatch.setattr(sharding, "NUMPY_BOUND", 0)
    rng = np.random.default_rng(9)
    drawn = collections.Counter(sharding._hypergeometric(rng, good, bad, n) for _ in range(3000))
    assert set(drawn) <= set(range(first, first + len(p)))
    assert all(abs(drawn[first + i] / 3000 - x) < 5 * (x * (1 - x) / 3000) ** 0.5 + 1e-3 for i, x in enumerate(want))


def test_draws_from_huge_urns():
    """Mean and variance of the probabilities of an urn of 10^12 rows, against the closed forms."""
    good, bad, n = 25 * 10**9, 975 * 10**9, 5_000_000
    first, p = sharding._probabilities(good, bad, n)
    k = first + np.arange(len(p))
    mean = (k * p).sum()
    assert abs(mean / (n * good / (good + bad)) - 1) < 1e-9
    var = n * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - n) / (good + bad - 1))
    assert abs(((k - mean) ** 2 * p).sum() / var - 1) < 1e-6


def test_orders_are_uniform(spark):
    """Every input partition has its share of each slot range, and input order says nothing of the output's."""
    rows = spark.range(0, 40_000, 1, 8).withColumn("m", F.create_map(F.lit("a"), "id"))  # a map has no order of its own
    got = sharding.assign(rows, 4).select("id", "shard", "slot").toPandas()
    assert sorted(got["id"]) == list(range(40_000)) and got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(10_000))).all()
    place = (got["shard"] * 10_000 + got["slot"]).to_numpy()
    assert abs(np.corrcoef(got["id"], place)[0, 1]) < 5 / 200
    order = got["id"].to_numpy()[np.argsort(place)]
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 5 / 200 and abs((np.diff(order) > 0).mean() - 0.5) < 0.015
    cells = np.histogram2d(got["id"], place, bins=20)[0]
    assert ((cells - 100) ** 2 / 100).sum() < 361 + 6 * (2 * 361) ** 0.5


def test_samples_of_labels_follow_their_bound(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    labels = docs.selectExpr("doc_id", "1 as toxic")
    hot = docs.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).select("doc_id", F.concat_ws(" ", "text", F.when(F.col("n") > 9, F.col("n").cast("string"))).alias("text"))
    one = learning.labelled_sample(hot, hot.select("doc_id", F.lit(1).alias("toxic")).distinct(), "toxic", 5, 9, 100)
    assert one.count() == 1 and one.columns == ["doc_id", "text", "label"]
    tight = learning.labelled_sample(docs.select("doc_id", "text"), labels, "toxic", 5, 0, 10_000, most_bytes=1000)
    assert 0 < tight.agg(F.sum(F.octet_length("text"))).first()[0] <= 1000
    few = learning.labelled_sample(docs, labels, "toxic", 5, 0, 300).count()
    assert 200 < few < 400 and learning.labelled_sample(docs, labels, "toxic", 5, 0, 10_000).count() == docs.where(learning.fold(F.col("doc_id"), 5) != 0).count()


def test_packing(spark):
    docs = awkward(spark).select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in docs.collect():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.asarray(ids[k : k + 4096], dtype="<u4").tobytes()
            want.append((d, k // 4096, k, len(part) // 4, zlib.crc32(part)))
    got = packing.packed_documents(docs).toPandas()
    assert sorted(want) == sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist()))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 4096
    assert got["sequence_id"].nunique() <= 1.02 * -(-got["length"].sum() // 4096) + 1


@pytest.mark.parametrize("text", ["it's We'LL don't", "<|endoftext|> x", "H̱ÉLLO ẞtraße 12½ ２", "a\x1cb\x85c d　e", "İstanbul ΑΣ", "", "don’t 'S", "éÅÅ ①Ⅳ", "ﬁ 你好 مرحبا", "a" * 3000])
def test_cached_tokens_equal_the_tokenizer(text):
    t = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        assert np.frombuffer(t.ids(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 10_000}, {3000: 5, 1096: 5}, {2049: 7}, {n: 3 for n in range(1, 4097, 13)}])
def test_plans_hold_each_piece_once(counts):
    used = collections.Counter()
    planned = packing.plan(counts)
    for lengths, k in planned:
        assert sum(lengths) <= 4096
        for n in lengths:
            used[n] += k
    assert used == collections.Counter(counts)
    best = sum(k for _, k in packing.best_fit_counts(dict(counts), 4096))
    assert sum(k for _, k in planned) <= best * 1.01 + 1
