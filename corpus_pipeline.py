"""From raw documents to packed sequences, in stages.

Each stage takes the documents that the stage before kept and returns documents with the same columns;
the last returns the packed pieces.

Defined results: rows with null or empty texts fail the quality rules; of rows with equal or nearly equal texts the
one of the smallest doc_id stays (a null doc_id is the greatest; of equal ones the one that is read first), and rows
of different texts stay whatever their doc_ids; texts are judged and packed whole, however long; columns of any
names are carried along up to the last stage; an empty table goes through every stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from learntrace.llm import decontam, packing, pii, quality_rules, simhash
from learntrace.llm.common import columns
from learntrace.session import ensure_checkpoint_dir


#: Words of a shingle, and the Jaccard similarity from which documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    judged = quality_rules.apply_policy(quality_rules.ledger(docs, out="_lt_quality"), ledger_col="_lt_quality", kept="_lt_kept")
    return judged.where("_lt_kept").select(*columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY).select(*columns(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*columns(docs))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with private spans replaced by their kinds and n_chars counted anew."""
    return pii.redact(docs).withColumn("n_chars", pii.text_length()).select(*columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", hide_private),
    ("packing", pack_sequences),
]

#: Fingerprints and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents of ``sf_dir``; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
