"""Folds and bounded labelled samples for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.llm.common import small_side
from learntrace.session import stored

SAMPLE_BYTES = 256 << 20  # of the texts of a sample


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def known_labels(labels: DataFrame, label: str, folds: int, held_out: int, key: str = "doc_id") -> DataFrame:
    """``_key`` and ``label`` of all labels that training may see: none of the held-out fold, a key once."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where(F.col(key).isNotNull() & F.col("label").isNotNull() & (fold(F.col(key), folds) != held_out))
    return known.groupBy("_key").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, key: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``key``, ``text`` and ``label`` of documents that training may see: none of the held-out fold, about ``rows`` of
    them, of ``most_bytes`` at most.

    The sample is drawn by a hash of the key over all labels, so its size has the bound ``rows`` in expectation whatever
    the table. Of rows that share a label's key the text of the smallest hash counts, so a key is one row however many have
    it. In the order of hashes, texts are taken as long as their bytes fit; sizes alone (a number a label drawn) decide that."""
    known = known_labels(labels, label, folds, held_out, key)
    bound = min(2**64, rows * 2**64 // max(1, known.count())) - 2**63  # of the whole range of the hash
    drawn = stored(known.where(F.xxhash64("_key") <= F.lit(bound - 1)))
    rows_of = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    at = F.xxhash64("_text").alias("h")
    sizes = rows_of.join(small_side(drawn), F.col("_k") == F.col("_key")).groupBy("_key", "label").agg(F.min(F.struct(at, F.octet_length("_text").cast("long").alias("n"))).alias("m"))
    told = sizes.select("_key", "label", "m.h", "m.n").toPandas().sort_values(["h", "_key"])  # about ``rows`` numbers
    fits = told[told["n"].cumsum() <= most_bytes]
    chosen = docs.sparkSession.createDataFrame(list(fits[["_key", "label", "h"]].itertuples(index=False, name=None)), sizes.select("_key", "label", "m.h").schema)
    one = rows_of.join(F.broadcast(chosen), (F.col("_k") == F.col("_key")) & (at == F.col("h"))).groupBy("_k", "label").agg(F.min("_text").alias(text))
    return one.select(F.col("_k").alias(key), text, "label")
