"""The canonical inputs, derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrace.functions.vectors import argmax
from learntrace.operators.pointwise import METRICS, pointwise_metrics
from learntrace.session import cut, ensure_checkpoint_dir

STEPS, CLASSES, SCALE = 6, 10, 10.0
LAYERS, LAYER_DIM = 4, 16
DIM, CHANNELS = 64, 4
EVENTS = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, label, step, z: six slices of an embedding as the logits of six checkpoints."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_id"), "label", "embedding")
    z = lambda t: F.transform(F.slice("embedding", t * CLASSES + 1, CLASSES), lambda x: x.cast("double") * SCALE)
    steps = F.array(*[F.struct(F.lit(t).alias("step"), z(t).alias("z")) for t in range(STEPS)])
    return rows.select("example_id", "label", F.explode(steps).alias("s")).select("example_id", "label", "s.step", "s.z")


def pointwise(spark: SparkSession, sf_dir: str, loss: bool = False) -> DataFrame:
    return pointwise_metrics(logits(spark, sf_dir), loss=loss)


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, step, acc over six steps."""
    return logits(spark, sf_dir).select("example_id", "step", (argmax(F.col("z")) == F.col("label")).alias("acc"))


def numbered(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("example_id"), (F.row_number().over(order) - 1).alias("step"), (F.col("value") > 50).alias("acc"))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, step, acc of each user's events in time order, as many steps as events."""
    return numbered(table(spark, sf_dir, "events"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, replicate, label, pred, acc: the checkpoints as an ensemble."""
    df = logits(spark, sf_dir).select("example_id", F.col("step").alias("replicate"), "label", argmax(F.col("z")).alias("pred"))
    return df.withColumn("acc", F.col("pred") == F.col("label"))


def activations(spark: SparkSession, sf_dir: str, copy: bool = False) -> DataFrame:
    """layer_idx, layer, example_id, label, act: four slices as layers; ``copy`` adds the first again as the last."""
    rows = table(spark, sf_dir, "embeddings")
    slices = [(i, f"block{i}.{'out' if i % 2 else 'in'}", i) for i in range(LAYERS)] + ([(LAYERS, "head.in", 0)] if copy else [])
    each = F.array(*[F.struct(F.lit(i).alias("layer_idx"), F.lit(n).alias("layer"), F.slice("embedding", s * LAYER_DIM + 1, LAYER_DIM).alias("act")) for i, n, s in slices])
    return rows.select(F.explode(each).alias("a"), F.col("vec_id").alias("example_id"), "label").select("a.layer_idx", "a.layer", "example_id", "label", "a.act")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, label, x: an embedding as four channels of 4 x 4 pixels."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_id"), "label", F.col("embedding").alias("x"))


def weights(spark: SparkSession, steps: int = STEPS) -> DataFrame:
    """step, class_idx, w, b of linear models, by an integer rule."""
    grid = spark.range(steps * CLASSES).select((F.col("id") / CLASSES).cast("int").alias("step"), (F.col("id") % CLASSES).cast("int").alias("class_idx"))
    w = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda j: ((31 * F.col("class_idx") + 17 * j + 7 * F.col("step")) % 13 - 6) / F.lit(13.0))
    return grid.withColumn("w", w).withColumn("b", F.lit(1.0))


#: Outputs of each layer of the layered models, and whether it has a relu; the first takes an embedding.
LAYERED = ((16, True), (12, True), (CLASSES, False))


def layered(spark: SparkSession, steps: int = 3) -> DataFrame:
    """step, layer_idx, name, w, b, activation of dense models with two hidden layers, by an integer rule."""
    def layer(i: int, name: str, inputs: int, outputs: int, relu: bool) -> Column:
        numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
        w = F.transform(numbers(inputs * outputs), lambda k: ((31 * F.floor(k / inputs) + 17 * (k % inputs) + 7 * F.col("id") + 5 * i) % 13 - 6) / F.lit(13.0))
        b = F.transform(numbers(outputs), lambda o: ((7 * o + 3 * i + F.col("id")) % 5 - 2) / F.lit(10.0))
        return F.struct(F.lit(i).alias("layer_idx"), F.lit(name).alias("name"), w.alias("w"), b.alias("b"), F.lit("relu" if relu else "none").alias("activation"))

    inputs = (DIM, *[n for n, _ in LAYERED])
    out = [layer(i, f"fc{i}", inputs[i], n, relu) for i, (n, relu) in enumerate(LAYERED)]
    return spark.range(steps).select(F.col("id").cast("int").alias("step"), F.explode(F.array(*out)).alias("l")).select("step", "l.*")


def metrics(spark: SparkSession, sf_dir: str, replicates: int = 3) -> DataFrame:
    """model, replicate, metric, example_id, value, is_train: the scores of two models of three replicates, or as
    many as six steps make of other ``replicates``."""
    df = pointwise(spark, sf_dir)
    run = df.withColumn("model", F.concat(F.lit("m"), F.floor(F.col("step") / replicates).cast("string"))).withColumn("replicate", F.col("step") % replicates)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    long = run.select("model", "replicate", "example_id", F.explode(each).alias("s"))
    return long.select("model", "replicate", "s.metric", "example_id", "s.value", ((F.col("example_id") + F.col("replicate")) % 2 == 0).alias("is_train"))


def stream_of(spark: SparkSession, steps: DataFrame, batches: int = 3, deal: Column | None = None) -> tuple[str, list[DataFrame]]:
    """A folder, and its (example_id, step, acc) in parts, a frame a trigger, by the order of steps within each example or by ``deal``:
    each is written to the folder, in as many files as it has partitions, when its turn comes."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    size = steps.groupBy("example_id").agg(F.count("*").alias("n"))
    part = F.floor(F.col("step") * batches / F.col("n")) if deal is None else deal
    held = cut(steps.join(size, "example_id").select("example_id", F.col("step").cast("long").alias("step"), "acc", part.cast("int").alias("part")))
    return folder, [held.where(F.col("part") == i).drop("part") for i in range(batches)]
