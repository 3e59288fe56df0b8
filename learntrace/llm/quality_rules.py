"""Quality rules as a bitmask ledger: every rule is judged once, policies and ablations read the bits.

``ledger`` stores each document's measurements and a ``failures`` mask with one bit a rule;
``apply_policy`` keeps or rejects by a versioned set of rules; ``ablation`` counts, by aggregates of the
masks' bits, what each rule rejects, alone and together.

Defined results: a null text has no words (all measurements 0, ``n_words`` 0, so it fails
``too_few_words`` and ``no_letters``); texts are measured whole; each row is judged alone, so
repeated rows give repeated results; an empty table gives an empty table (an ablation: zeros); other columns stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.llm.common import WS, columns, let

WINDOW = 8  # words in a window that counts as repeated


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text.

    Windows are compared by XXH64 of their words; a text whose windows all differ costs one hash
    set. Else the windows are sorted by hash, those equal to a neighbour give their starts, and the
    sorted starts are summed as a union of intervals, so the cost is n log n at any repetition."""
    def repeated(h: Column) -> Column:
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, i, d: F.coalesce(F.get(s, i + d)["h"] == e["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda e, i: same(e, i, -1) | same(e, i, 1)), lambda e: e["i"]))

        def covered(p: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
            step = lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last"))
            return F.aggregate(p, zero, step)["n"]

        return let(let(keyed, starts), covered)

    def counted(w: Column) -> Column:
        n = F.size(w) - (window - 1)
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(n > 1, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0).cast("long"))))

    return F.coalesce(let(words, counted), F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition on the measurements; ``bit`` never changes its meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 6 and 100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)"),
    Rule(5, "no_letters", "2 * n_letters < word_chars or word_chars = 0"),
    Rule(6, "capitals", "2 * n_capitals > n_letters and n_letters > 0"),
    Rule(7, "exclamations", "10 * n_exclamations > n_words and n_words > 0"),
)
BASE_BITS = (0, 1)
#: Version: the bits that reject. A published version is never edited.
POLICIES = {"v1": BASE_BITS, "v2": (0, 1, 2, 3, 4, 5, 6, 7)}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_exclamations")


def mask_of(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def ledger(docs: DataFrame, text: str = "text", out: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` and a struct ``out`` of the measurements and the ``failures`` mask; a column ``out`` of the
    input is replaced."""
    had = columns(docs, out)
    t, w, x = "_lt_text", "_lt_words", "_lt_lines"
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({w: F.filter(F.split(t, f"[{WS}]+"), lambda v: v != ""), x: F.filter(F.split(t, "\n"), lambda v: v.rlike(f"[^{WS}]"))})
    length = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    values = {
        "n_words": F.size(w), "word_chars": length(f"[{WS}]+"), "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
        "n_lines": F.size(x), "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)), "n_repeat_words": n_repeat_words(F.col(w)),
        "n_letters": length(r"\P{L}+"), "n_capitals": length(r"\P{Lu}+"), "n_exclamations": F.length(t) - F.length(F.translate(t, "!", "")),
    }
    df = df.withColumn(out, F.struct(*[values[k].cast("long").alias(k) for k in MEASURES]))
    inner = df.select(*had, out, F.struct(*[F.col(f"{out}.{k}").alias(k) for k in MEASURES]).alias("_lt_m"))
    bit = lambda r: F.when(_condition(r.fails, "_lt_m"), F.lit(1 << r.bit)).otherwise(0)
    failures = sum((bit(r) for r in rules[1:]), bit(rules[0])).cast("long").alias("failures")
    return inner.select(*had, F.struct(*[F.col(f"{out}.{k}").alias(k) for k in MEASURES], failures).alias(out))


def _condition(sql: str, struct: str) -> Column:
    return F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"{struct}.\1", sql))


def apply_policy(entries: DataFrame, version: str = CURRENT, ledger_col: str = "quality", kept: str = "kept") -> DataFrame:
    """Adds ``kept``: none of the version's bits is set."""
    return entries.withColumn(kept, F.col(f"{ledger_col}.failures").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablation(entries: DataFrame, version: str = CURRENT, ledger_col: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each rule of the version: documents it fails, fails alone, and kept without it.

    All rules are counted in one pass by operations on the mask's bits; a partition sends three numbers a rule."""
    bits = POLICIES[version]
    failed = F.col(f"{ledger_col}.failures").bitwiseAND(F.lit(mask_of(bits)))
    own = [r for r in rules if r.bit in bits]
    sums = {
        f"{r.bit}": F.struct(
            F.coalesce(F.sum(F.getbit(failed, F.lit(r.bit)).cast("long")), F.lit(0)).alias("failed"),
            F.count_if(failed == 1 << r.bit).alias("failed_alone"),
            F.count_if(failed.bitwiseAND(F.lit(mask_of(bits) & ~(1 << r.bit))) == 0).alias("kept_without"),
        )
        for r in own
    }
    counted = entries.agg(*[s.alias(n) for n, s in sums.items()])
    rows = F.array(*[F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), *[F.col(f"`{r.bit}`.{c}").alias(c) for c in ("failed", "failed_alone", "kept_without")]) for r in own])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def quality_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: measurements, the base verdict, the policy's verdict and the mask."""
    df = apply_policy(ledger(docs.select("doc_id", "text")))
    base = F.col("quality.failures").bitwiseAND(F.lit(mask_of(BASE_BITS))) != 0
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select("doc_id", *[F.col(f"quality.{k}").alias(k) for k in shown], base.alias("base_failed"), "kept", F.col("quality.failures").alias("failures"))
