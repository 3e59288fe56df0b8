"""Online trajectory scores.

First and last events are mergeable, so plain streaming aggregation keeps them. Counts of edges look at the step before,
which may not have come yet: the state store keeps the segments of :mod:`learntrace.operators.segments`, so
steps may arrive in any order and any parts, steps that come again change nothing, and the state is as large as there are gaps. A
stream may start from the segments of a saved batch, and its state can be read as a table. A call of Python and of the state store costs
milliseconds, so a state holds a bucket of examples as arrays and what a trigger brings them is merged at once; a trigger
rewrites the buckets that it touches.

Results go through foreachBatch to Parquet in the shared folder, one folder a batch, and are read back
as each key's latest row; the checkpoint folder resumes a stopped query where it ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from learntrace.operators import segments
from learntrace.operators.forgetting import first_forget, first_learn, first_unforgettable, first_unlearnable
from learntrace.session import ensure_checkpoint_dir

SCORES = "example_id long, n long, countforget long, unforgettable boolean, firstlearn long, firstunforgettable long"
STATE = ", ".join(f"{c} array<{'boolean' if kind is bool else 'long'}>" for c, kind in segments.FIELDS.items())
BUCKETS = 1_024  # of examples; a checkpoint keeps the number that it began with
UNNAMED = -1  # bucket of the rows without an example_id
MERGE_ROWS = 100_000  # new steps of a bucket that are merged at once, or as many as it holds if these are more
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ForgetProcessor(StatefulProcessor):
    """The segments of a bucket's examples, a list a field."""

    def __init__(self, start_at_zero: bool, stride: int) -> None:
        self.start_at_zero, self.stride = start_at_zero, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.segments = handle.getValueState("segments", STATE)

    def _held(self) -> segments.Table:
        return segments.table(self.segments.get() or [[] for _ in segments.FIELDS])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, waiting, came = self._held(), [], []
        for frame in rows:
            ids, step = frame["example_id"].to_numpy(), frame["step"].astype("int64").to_numpy()
            waiting.append(segments.of_steps(ids, step, (frame["acc"].to_numpy() == True).astype(bool)))  # noqa: E712 null is wrong
            came.append(np.unique(ids))
            if sum(len(w["first"]) for w in waiting) >= max(MERGE_ROWS, len(now["first"])):
                now, waiting = segments.merged(now, segments.joined(waiting), self.stride), []
        now = segments.merged(now, segments.joined(waiting), self.stride) if waiting else now
        self.segments.update(segments.lists(now))
        asked = np.isin(now["example_id"], np.concatenate(came))
        found = segments.scores({c: x[asked] for c, x in now.items()}, self.start_at_zero, self.stride)
        yield pd.DataFrame(found if key[0] != UNNAMED else found | {"example_id": [None]})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        saved = segments.table([None if pd.isna(v) else int(v) for v in initialState[c].tolist()] for c in segments.FIELDS)
        self.segments.update(segments.lists(segments.merged(self._held(), saved, self.stride)))

    def close(self) -> None:
        pass


def _in_buckets(rows: DataFrame) -> GroupedData:
    """``rows`` by the bucket of their example."""
    own = F.col("example_id")
    bucket = F.when(own.isNull(), UNNAMED).otherwise(F.pmod(F.xxhash64(own), F.lit(BUCKETS))).cast("int")
    return rows.withColumns({"bucket": bucket, "example_id": F.coalesce(own.cast("long"), F.lit(0))}).groupBy("bucket")


def forget_scores(stream: DataFrame, start_at_zero: bool = True, saved: DataFrame | None = None, stride: int = 1) -> DataFrame:
    """A row for each key with new steps (example_id, step, acc): the scores so far.

    ``saved`` (segments of :func:`segments.segments_of`) is what the stream starts from; ``stride`` is the distance of steps."""
    start = None if saved is None else _in_buckets(saved.select(*segments.FIELDS))
    steps = _in_buckets(stream.select("example_id", "step", "acc"))
    return steps.transformWithStateInPandas(ForgetProcessor(start_at_zero, stride), SCORES, "Update", "None", start)


def event_times(stream: DataFrame) -> DataFrame:
    """firstlearn, firstunforgettable, firstforget and firstunlearnable by plain streaming aggregation."""
    ends = {"firstlearn": first_learn(), "firstunforgettable": first_unforgettable(), "firstforget": first_forget(), "firstunlearnable": first_unlearnable()}
    return stream.groupBy("example_id").agg(F.count("*").alias("n"), *[c.cast("long").alias(k) for k, c in ends.items()])


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that states of several variables need, while a query starts and runs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drain(result: DataFrame, mode: str = "update", folder: str | None = None) -> DataFrame:
    """Runs a streaming frame over what there is and returns each example's latest row.

    With a ``folder`` of an earlier call, the query resumes from its checkpoint and adds to its results."""
    spark: SparkSession = result.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with state_store(spark):
        result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    cols = result.columns
    latest = F.max(F.struct("batch", *cols))
    return rows.groupBy("example_id").agg(latest.alias("_l")).select(*[F.col(f"_l.{c}").alias(c) for c in cols])


def results_folder(folder: str) -> str:
    """Where :func:`drain_parts` keeps the results and the checkpoint of the steps of a folder."""
    return f"{folder.rstrip('/')}-scores"


def drain_parts(spark: SparkSession, folder: str, parts: list[DataFrame], schema: str, scores: Callable[[DataFrame], DataFrame], mode: str = "update") -> DataFrame:
    """The scores of steps that arrive in parts: each is written to the folder and drained by the same query, which
    resumes from its checkpoint, so a part may have any number of files and its rows any order."""
    found = None
    for part in parts:
        part.write.mode("append").parquet(folder)
        found = drain(scores(read_steps(spark, folder, "*.parquet", schema, files_per_trigger=None)), mode, results_folder(folder))
    return found


def read_state(spark: SparkSession, folder: str, variable: str = "segments") -> DataFrame:
    """The state that the query of a results folder holds, as a table of its keys and values; of segments, a row each."""
    with state_store(spark):
        state = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", variable).load()
    if variable == "segments":
        each = state.select("key.bucket", F.explode(F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in segments.FIELDS])).alias("s")).select("bucket", "s.*")
        return each.withColumn("example_id", F.when(F.col("bucket") != UNNAMED, F.col("example_id"))).drop("bucket")
    return state.select("key.*", "user_map_key.*", "user_map_value.*") if "user_map_key" in state.columns else state.select("key.*", "value.*")


def read_steps(spark: SparkSession, folder: str, glob: str, schema: str, files_per_trigger: int | None = 1, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A file stream of Parquet files with an explicit schema; without ``files_per_trigger``, all there are at once."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    source = source if files_per_trigger is None else source.option("maxFilesPerTrigger", files_per_trigger)
    return shape(source.parquet(folder))
