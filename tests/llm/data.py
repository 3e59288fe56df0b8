"""Awkward rows: nulls, empty and very long texts, repeats, and columns whose names clash."""

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potions near an old stone bridge and talk about the coming winter"
CLEAN = WORDS + ". " + WORDS.replace("quick", "slow") + "."


def awkward(spark):
    rows = [
        (1, CLEAN, "en", "s0", None), (2, None, None, None, None), (3, "", "en", "s0", 0), (4, " \n\t ", "de", "s0", 4), (5, "word", "en", "s0", 4),
        (6, CLEAN, "en", "s0", 1), (6, CLEAN, "en", "s0", 1), (7, "x" * 200_000, "en", "s1", 200_000), (8, "ab cd " * 30_000, "en", "s1", 180_000),
        (9, "é😀 ǘ   naïve text ﬁ", "fr", "s1", 20), (None, "a row without an id", "en", "s1", 19), (10, "\n".join([CLEAN] * 40), "en", "s0", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("score", "fp", "label", "h", "pos", "item_id", "shard", "slot", "piece", "length", "kept", "quality", "pii", "license", "component_id", "n_words", "_text", "_key", "a.b")
    return df.withColumns({c: F.lit("kept as it is") for c in clash})


def plain_docs(spark):
    return awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
