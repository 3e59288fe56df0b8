"""Published scores, and array files in binary columns.

Scores that others have published come as one array file a score, data set and split. ``PUBLISHED`` lists the files
and what may be chosen for each; :func:`published` checks the choices, finds the file under a root folder and reads
its arrays as columns through the data source of :mod:`learntrace.sources.array_source`.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learntrace.sources.array_source import read_arrays, write_arrays

CHUNK = 1 << 16


@dataclass(frozen=True)
class Published:
    """A family of files: its folder, the name with its choices, the values of each choice with their short forms in the
    name, and the members with their column names."""

    folder: str
    name: str
    choices: dict[str, dict[str, str]]
    members: dict[str, str]
    defaults: dict[str, str] = field(default_factory=dict)


def _plain(*values: str) -> dict[str, str]:
    return {v: v for v in values}


#: Folders and names of published files, their data sets, metrics, models and members.
PUBLISHED = {
    "order": Published(
        "carlini-et-al-metrics-order", "order_{dataset}_{metric}_{split}.npy",
        {"dataset": {"cifar10": "cifar", "fashionmnist": "fashion", "mnist": "mnist", "imagenet": "imagenet"}, "metric": _plain("adv", "agr", "conf", "priv", "ret"), "split": _plain("train", "test")},
        {"value": "example_id"}, {"split": "train"},
    ),
    "memorization": Published("feldman-zhang-influence-memorization", "memorization-{dataset}-0.7.npz", {"dataset": _plain("cifar100")}, {"arr_0": "value"}),
    "influence": Published(
        "feldman-zhang-influence-memorization", "{dataset}_high_infl_pairs_infl0.15_mem0.25.npz", {"dataset": _plain("cifar100")},
        {"tr_idx": "tr_idx", "tt_idx": "tt_idx", "infl": "infl", "mem": "mem"}, {"dataset": "cifar100"},
    ),
    "prototypes": Published("sorscher-selfproto", "selfproto-{dataset}-{model}.npz", {"dataset": _plain("cifar10", "cifar100"), "model": _plain("swav")}, {"arr_0": "value"}, {"model": "swav"}),
}


def path_of(root: str, family: str, **chosen: str) -> str:
    """The file of a family under ``root``; a choice that is not published is a ValueError."""
    files, chosen = PUBLISHED[family], PUBLISHED[family].defaults | chosen
    short = {}
    for name, values in files.choices.items():
        if chosen.get(name) not in values:
            raise ValueError(f"{family}: no {name} {chosen.get(name)!r}; published are {', '.join(values)}")
        short[name] = values[chosen[name]]
    return f"{root.rstrip('/')}/{files.folder}/{files.name.format(**short)}"


def decoded(files: DataFrame, member: str | None = None, value: str = "double", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, value) of array files in a binary column ``content``, or of one member of theirs; rows follow in chunks."""
    schema = T.StructType([*[files.schema[k] for k in keys], T.StructField("pos", T.LongType()), T.StructField("value", T.DataType.fromDDL(value))])

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                got = np.load(io.BytesIO(row.content), allow_pickle=False)
                flat = np.ravel(got if member is None else got[member])
                for at in range(0, len(flat), CHUNK):
                    part = flat[at : at + CHUNK]
                    yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "pos": np.arange(at, at + len(part)), "value": part})

    return files.select(*keys, "content").mapInPandas(decode, schema)


def encoded(rows: DataFrame, keys: list[str], values: str) -> DataFrame:
    """``keys`` and ``content``, each row's array column as the bytes of an array file."""
    def encode(arrays: pd.Series) -> pd.Series:
        def content(a: np.ndarray) -> bytes:
            buffer = io.BytesIO()
            np.save(buffer, np.asarray(a))
            return buffer.getvalue()

        return arrays.map(content)

    encode.__annotations__ = {"arrays": pd.Series, "return": pd.Series}
    return rows.select(*keys, F.pandas_udf(encode, "binary")(values).alias("content"))


def published(spark: SparkSession, root: str, family: str, members: list[str] | None = None, partition_rows: int | None = None, **chosen: str) -> DataFrame:
    """``pos`` and a column for each member (or the named ones) of a published file, all from one pass over it."""
    named = PUBLISHED[family].members
    wanted = [m for m in named if members is None or m in members]
    return read_arrays(spark, path_of(root, family, **chosen), wanted, partition_rows).withColumnsRenamed({m: named[m] for m in wanted})


def publish(rows: DataFrame, root: str, family: str, **chosen: str) -> None:
    """``pos`` and the family's columns as the file of the given choices."""
    named = PUBLISHED[family].members
    write_arrays(rows.select("pos", *[F.col(c).alias(m) for m, c in named.items()]), path_of(root, family, **chosen))


def read_order(spark: SparkSession, root: str, metric: str, dataset: str, train: bool = True) -> DataFrame:
    """(rank, example_id) of a published order: the array's place is the rank of the example it names."""
    return published(spark, root, "order", metric=metric, dataset=dataset, split="train" if train else "test").withColumnRenamed("pos", "rank")


def read_orders(spark: SparkSession, root: str, dataset: str, train: bool = True) -> DataFrame:
    """All published orders of a data set in long form: metric, rank, example_id."""
    metrics = PUBLISHED["order"].choices["metric"]
    return reduce(DataFrame.unionByName, [read_order(spark, root, m, dataset, train).withColumn("metric", F.lit(m)) for m in metrics])


def read_memorization(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return published(spark, root, "memorization", dataset=dataset).withColumnRenamed("pos", "example_id")


def read_prototype_distances(spark: SparkSession, root: str, dataset: str, model: str = "swav") -> DataFrame:
    return published(spark, root, "prototypes", dataset=dataset, model=model).withColumnRenamed("pos", "example_id")


def read_influence(spark: SparkSession, root: str, dataset: str = "cifar100") -> DataFrame:
    """pos, tr_idx, tt_idx, infl and mem side by side; a shorter array is null beyond its end."""
    return published(spark, root, "influence", dataset=dataset)
