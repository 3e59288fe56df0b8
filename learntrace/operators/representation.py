"""Scores from hidden representations: neighbours, prediction depth and prototypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learntrace.functions.pointwise import softmax
from learntrace.functions.vectors import distance, doubles
from learntrace.operators.forgetting import first_unforgettable
from learntrace.operators.layers import append_layer
from learntrace.operators.neighbours import nearest
from learntrace.operators.pointwise import pointwise_metrics

CHUNK_PAIRS = 1 << 21  # distances held at once


def knn_predict(train: DataFrame, test: DataFrame | None = None, k: int = 30) -> DataFrame:
    """Whether the majority of the k nearest training rows has the query's label: layer_idx, example_id,
    pred, match. Without ``test`` the training rows are the queries, each its own neighbour too.
    Equal votes go to the smaller label."""
    queries = train if test is None else test
    votes = nearest(train, queries, k).groupBy("layer_idx", "query_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("layer_idx", "query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("pred"))
    own = queries.select("layer_idx", F.col("example_id").alias("query_id"), F.col("label").alias("_y"))
    return best.join(own, ["layer_idx", "query_id"]).select("layer_idx", F.col("query_id").alias("example_id"), "pred", (F.col("pred") == F.col("_y")).alias("match"))


def prediction_depth(train: DataFrame, test: DataFrame | None = None, k: int = 30) -> DataFrame:
    """The layer from which on neighbours predict the label: 0 always, the number of layers never."""
    matches = knn_predict(train, test, k)
    return matches.groupBy("example_id").agg(first_unforgettable("match", "layer_idx").alias("pd"))


def layer_matches(matches: DataFrame, layers: list[int]) -> DataFrame:
    """One column ``pdlayer{i}`` a layer."""
    wide = matches.groupBy("example_id").pivot("layer_idx", layers).agg(F.first("match"))
    return wide.select("example_id", *[F.col(str(i)).alias(f"pdlayer{i}") for i in layers])


def centroids(rows: DataFrame, label: str = "label", act: str = "act") -> DataFrame:
    """Mean vector of each label: long form, so that the partial sums meet by label and place."""
    long = rows.select(label, F.posexplode(doubles(F.col(act))).alias("pos", "x"))
    means = long.groupBy(label, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))


def supervised_prototypes(rows: DataFrame, label: str = "label", act: str = "act", out: str = "proto") -> DataFrame:
    """Distance of each row to its own label's mean."""
    joined = rows.join(centroids(rows, label, act), label)
    return joined.select("example_id", label, distance(doubles(F.col(act)), F.col("center")).alias(out))


def cluster_centers(rows: DataFrame, k: int = 30, max_iter: int = 300, seed: int = 42, act: str = "act") -> np.ndarray:
    """Centres of k clusters, by distributed k-means."""
    held = rows.select(array_to_vector(doubles(F.col(act))).alias("features"))
    return np.array(KMeans(k=k, maxIter=max_iter, seed=seed, tol=0.0).fit(held).clusterCenters())


def center_distances(rows: DataFrame, centers: np.ndarray, act: str = "act", out: str = "selfproto") -> DataFrame:
    """Distance (not squared) of each row to the nearest of the centres, which go to the tasks as one array."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=float))

    def near(vectors: pd.Series) -> pd.Series:
        c, found = shared.value, np.empty(len(vectors))
        step = max(1, CHUNK_PAIRS // max(1, c.size))
        for at in range(0, len(vectors), step):
            x = np.stack(vectors.iloc[at : at + step])
            found[at : at + len(x)] = np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2)).min(axis=1)
        return pd.Series(found)

    near.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return rows.select("example_id", F.pandas_udf(near, "double")(doubles(F.col(act))).alias(out))


def self_supervised_prototypes(rows: DataFrame, k: int = 30, max_iter: int = 300, seed: int = 42, act: str = "act", out: str = "selfproto") -> DataFrame:
    """Distance of each row to the nearest of k cluster centres."""
    return center_distances(rows, cluster_centers(rows, k, max_iter, seed, act), act, out)


def representation_metrics(
    activations: DataFrame, k: int = 30, clusters: int | None = None, layers: list[int] | None = None, proto_layer: int | None = None, outputs: DataFrame | None = None,
    softmax_layer: bool = False, test: DataFrame | None = None, test_outputs: DataFrame | None = None, train_labels: DataFrame | None = None, pointwise: bool = False,
    max_iter: int = 300, seed: int = 42,
) -> DataFrame:
    """proto (distance to the label's mean), selfproto (to the nearest of ``clusters`` centres, if given), pd and the
    matches of every layer, a row an example.

    ``layers`` and ``proto_layer`` choose layers (None: all, the last). ``outputs`` (example_id, label, z) adds the
    softmax as a last layer (``softmax_layer``) and the pointwise scores (``pointwise``). ``train_labels`` (example_id, label)
    replaces the labels that neighbours vote with. With ``test`` depth and matches are of the test rows and the other
    scores of the training rows; rows of both are joined by example_id."""
    rows = activations if layers is None else activations.where(F.col("layer_idx").isin(layers))
    asked = test if test is None or layers is None else test.where(F.col("layer_idx").isin(layers))
    at = proto_layer if proto_layer is not None else activations.agg(F.max("layer_idx")).first()[0]
    last = activations.where(F.col("layer_idx") == at)
    if softmax_layer:
        rows = append_softmax(rows, outputs)
        asked = asked if asked is None else append_softmax(asked, test_outputs)
    voters = rows if train_labels is None else rows.drop("label").join(train_labels.select("example_id", "label"), "example_id").select(*rows.columns)
    matches = knn_predict(voters, asked, k)
    depth = matches.groupBy("example_id").agg(first_unforgettable("match", "layer_idx").alias("pd"))
    numbers = sorted(r[0] for r in rows.select("layer_idx").distinct().collect())  # a model's layers: tens
    out = supervised_prototypes(last).join(depth.join(layer_matches(matches, numbers), "example_id"), "example_id", "full")
    if clusters is not None:
        out = out.join(self_supervised_prototypes(last, clusters, max_iter, seed), "example_id", "left")
    return out if not pointwise else out.join(pointwise_metrics(outputs).drop("label"), "example_id", "left")


def append_softmax(activations: DataFrame, outputs: DataFrame) -> DataFrame:
    """The softmax of (example_id, label, z) as the layer after the last."""
    p = F.transform(softmax(F.col("z")), lambda x: F.round(x, 9))
    return append_layer(activations.withColumn("act", doubles(F.col("act"))), outputs.select("example_id", "label", p.alias("act")), "softmax")
