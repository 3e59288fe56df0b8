"""Metric folders, run tables and saved accumulator states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HPARAMS = "path STRING, model_name STRING, custom_train_test_split BOOLEAN"
PARTITIONS = ("model", "replicate", "metric")
FILE_ROWS = 1_000_000  # expected rows of a file


def read_hparams(spark: SparkSession, path: str, schema: str = HPARAMS) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def list_metric_files(spark: SparkSession, folder: str, include: list[str] | None = None, suffix: str = "_metrics.pt") -> DataFrame:
    """Files of a folder that end with ``suffix`` and hold any of ``include``: path, name and the parts of
    the name but the last. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    if include:
        named = named.where(F.exists(F.array(*[F.lit(x) for x in include]), lambda x: F.contains(F.col("name"), x)))
    parts = F.split("name", "_")
    return named.withColumn("parts", F.array_append(F.slice(parts, 1, F.size(parts) - 1), F.col("path")))


def list_checkpoints(spark: SparkSession, folder: str, pattern: str = r"step=([0-9]+)") -> DataFrame:
    """The checkpoints of a folder: ``step``, the number that the pattern finds in a path, and its files, in order of steps."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = files.withColumn("step", F.regexp_extract("path", pattern, 1)).where("step <> ''").withColumn("step", F.col("step").cast("long"))
    return found.groupBy("step").agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy("step")  # a checkpoint's files: few


def write_metrics(metrics: DataFrame, folder: str, item: str = "example_id") -> None:
    """The long metric table, in folders by model, replicate and metric, so that reads prune to what they name.

    A run's rows are dealt over as many tasks as its size asks for, by a hash of the item."""
    largest = metrics.groupBy(*PARTITIONS).count().agg(F.max("count")).first()[0] or 0
    salt = F.pmod(F.xxhash64(item), F.lit(max(1, -(-largest // FILE_ROWS))))
    metrics.repartition(*PARTITIONS, salt).write.partitionBy(*PARTITIONS).mode("overwrite").parquet(folder)


def read_metrics(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The long metric table and its distinct models, replicates and metrics (from partition folders alone)."""
    df = spark.read.option("basePath", folder).parquet(folder)
    return df, df.select(*PARTITIONS).distinct()


def write_csv(wide: DataFrame, folder: str) -> None:
    """An export table as CSV files with a header each, as many as it has partitions."""
    wide.write.mode("overwrite").option("header", True).csv(folder)


def save_state(state: DataFrame, folder: str, kind: str, metadata: dict[str, str | int | float] | None = None, lists: dict[str, list] | None = None) -> None:
    """An accumulator's state with its kind, metadata and metadata lists; nulls are states not begun."""
    metadata, lists = metadata or {}, lists or {}
    taken = set(state.columns) & (set(metadata) | set(lists))
    if taken:
        raise ValueError(f"metadata names are columns of the state: {sorted(taken)}")
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{folder}/data")
    rows = [("kind", None, "str", kind), *[(k, None, type(v).__name__, str(v)) for k, v in metadata.items()], *[(k, i, type(v).__name__, str(v)) for k, vs in lists.items() for i, v in enumerate(vs)]]
    spark.createDataFrame(rows, "key string, seq int, type string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def load_state(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, dict, dict]:
    """State, metadata and lists as they were saved; a ValueError if another kind was saved there."""
    cast = {"str": str, "int": int, "float": float}
    metadata: dict = {}
    lists: dict[str, list] = {}
    for r in spark.read.parquet(f"{folder}/meta").orderBy("key", "seq").collect():  # a few entries
        value = cast[r["type"]](r["value"])
        if r["seq"] is None:
            metadata[r["key"]] = value
        else:
            lists.setdefault(r["key"], []).append(value)
    if metadata.pop("kind") != kind:
        raise ValueError(f"{folder} holds no {kind}")
    return spark.read.parquet(f"{folder}/data"), metadata, lists


def parse_type(name: str) -> T.DataType:
    """A type from its DDL name; a ValueError if there is none."""
    try:
        return T.DataType.fromDDL(name)
    except Exception as e:
        raise ValueError(f"no type {name!r}") from e


def rename_all(df: DataFrame, columns: list[str], prefix: str | None = None, cast: str | None = None) -> DataFrame:
    """The named columns, cast and with ``{prefix}_`` before their names; other columns stay."""
    kind = parse_type(cast) if cast else None
    shaped = [(F.col(c) if kind is None else F.col(c).cast(kind)).alias(f"{prefix}_{c}" if prefix else c) for c in columns]
    return df.select(*[c for c in df.columns if c not in columns], *shaped)
