"""Leaks whose slots are partly changed, or whose capitals are lost."""

import collections
import random
import re

import pandas as pd

from learntrace.llm import decontam
from tests.conftest import SF

ITEM = "The old farmer who lives by the river sold 2 apples to Mary before the long winter came, and then the same farmer walked slowly over the wooden bridge and up the steep hill to buy 2 pears from Peter at the market"


def found(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["n_found"] / r["n_windows"] for r in decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_one_inconsistent_slot_drops_its_windows_only(spark):
    texts = [ITEM, ITEM.replace("2 pears", "7 pears"), ITEM.replace("2 apples", "3 apples").replace("2 pears", "5 pears"), ITEM.replace("Mary", "Anna").replace("2", "9")]
    got = found(spark, ITEM, texts)
    assert set(got) == {0, 1, 2, 3} and got[0] == got[3] == 1 and 0.8 <= got[1] < 1 and 0.8 <= got[2] < 1


def test_copies_without_capitals_and_in_capitals(spark):
    item = "If John has 3 apples and Mary has 5 pears, how many does John give to Mary so that John and Mary have equal shares?"
    assert found(spark, item, [item.lower(), item.upper(), item]) == {0: 1, 1: 1, 2: 1}


def test_runs_of_names_are_one_placeholder(spark):
    item = "Every morning young Mary Ann Smith and her friend Bob Lee Carter walk 3 miles along the quiet river to the old school near the bridge"
    other = item.replace("Mary Ann Smith", "Zoe").replace("Bob Lee Carter", "Tim Otto").replace("3", "8")
    assert found(spark, item, [item, other, item.lower(), item.upper()]) == {0: 1, 1: 1, 2: 1, 3: 1}


def marked(text):
    """Tokens as (placeholder or None, value), by a walk over the text's letter and digit runs."""
    out, last_end = [], None
    for m in re.finditer(r"[^\W\d_]+|\d+", text):
        word, gap = m.group(), text[last_end : m.start()] if last_end is not None else ""
        last_end = m.end()
        if word.isdigit():
            out.append(("0d", word))
        elif out and 1 <= len(gap) <= 6 and not set(gap) & set(".!?:") and word[0].isupper() and word[1:2].islower():
            if out[-1][0] == "0n" and set(gap) == {" "}:
                out[-1] = ("0n", out[-1][1] + word.lower())
            else:
                out.append(("0n", word.lower()))
        elif out and out[-1][0] == "0d" and word.lower() in decontam.UNITS and set(gap) <= {" "}:
            out.append(("0u", word.lower()))
        else:
            out.append((None, word.lower()))
    return out


def cut_up(tokens):
    return [(tuple(k or v for k, v in w), w if any(k for k, _ in w) else None) for w in (tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4))]


def forms(item):
    """The windows that stand for an item, by place: as written, as lower-case letters, and the first as after a word."""
    def literal(w):
        return 5 if w[1] is None else sum(k is None for k, _ in w[1])

    plain = [(i, w) for i, w in enumerate(cut_up(marked(item))) if literal(w) >= 3] + [(0, w) for w in cut_up(marked("x " + item))[1:2] if literal(w) >= 3]
    places = {i for i, _ in plain}
    kept = {}
    for i, (h, values) in plain + [(i, w) for i, w in enumerate(cut_up(marked(item.lower()))) if i in places]:
        kept.setdefault((i, h), values)
    return kept, places


def covered(item, text):
    kept, places = forms(item)
    diagonals = collections.defaultdict(set)
    for pos, (h, values) in enumerate(cut_up(marked(text))):
        for (at, h2), asked in kept.items():
            if h == h2:
                diagonals[pos - at].add((at, asked, values))
    good = set()
    for windows in diagonals.values():
        slots = {(at + k, asked[k], values[k]) for at, asked, values in windows if asked for k in range(5) if asked[k][0]}
        bound = {}
        for a in {a for _, a, _ in slots}:
            seen = collections.defaultdict(list)
            for place, asked, value in slots:
                if asked == a:
                    seen[value].append(place)
            bound[a] = max(seen, key=lambda v: (len(seen[v]), v == a, -min(seen[v]), v[0] + v[1]))
        good |= {at for at, asked, values in windows if not asked or asked == values or all(bound[asked[k]] == values[k] for k in range(5) if asked[k][0])}
    return len(good) / len(places) if places else 0.0


def test_reparameterised_benchmark_equals_brute_force(spark):
    """Items of the table with numbers, names and units put in, and documents that ask them again in other words,
    alike, changed alike, changed apart, in small letters, in part."""
    rng = random.Random(7)
    names = ["Mary", "Bob Lee", "Anna Maria Rossi", "Otto", "Zoe Carter"]
    items, docs = [], []
    for i, t in enumerate(pd.read_parquet(f"{SF}/benchmark.parquet")["text"].head(12)):
        words = t.split()[:40]
        held = {"A": rng.choice(names), "B": rng.choice(names), "P": str(rng.randrange(2, 9)), "Q": str(rng.randrange(10, 99)), "U": "km"}
        for k in range(3, len(words), 7):
            words.insert(k, rng.choice(["{A}", "{B}", "{P} {U}", "{Q}", "{A} and {B}", "{P}"]))
        shape = " ".join(w if w.startswith("{") else w.replace("{", "").replace("}", "") for w in words)
        items.append((i, shape.format(**held)))
        fresh = {"A": rng.choice(names), "B": rng.choice(names), "P": "41", "Q": "730", "U": "miles"}
        near, again = shape.format(**held), shape.format(**fresh)
        half = " ".join(again.split()[: len(again.split()) // 2])
        apart = near.replace(held["P"], "5", 1).replace(held["A"], "Ida", 1)
        mixed = "".join(c if rng.random() < 0.98 else "q" for c in again)
        docs += [near, again, f"She said that {again} And so on.", near.lower(), near.upper(), again.lower(), half, apart, mixed, near + " " + again]
    rows = list(enumerate(docs))
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): round(c, 6) for d, text in rows for i, item in items for c in [covered(item, text)] if round(c, 6) >= 0.8}
    assert got == want and len({i for _, i in want}) == len(items) and len(docs) // 2 < len({d for d, _ in want}) < len(docs)
