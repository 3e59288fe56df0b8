"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrace.functions import pointwise as fn
from learntrace.functions.vectors import argmax, doubles, one_hot, p_norm, steady, total
from learntrace.operators import aggregates, analysis, combine, ensemble, forgetting, frames, gradient, layered, layers, observed, ranking, representation, segments
from learntrace.operators.pointwise import METRICS, evaluate, pointwise_metrics
from learntrace.plans import fixtures as fx
from learntrace.plans.oracles import ORACLES
from learntrace.session import cut, ensure_checkpoint_dir
from learntrace.sources import arrays, bucketed, metrics
from learntrace.sql.functions import register_functions
from learntrace.sql.tables import register_tables
from learntrace.streaming import accumulators, online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DOUBLES = METRICS[1:]
RUN = ["model", "replicate", "metric"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: steady(F.col(c), digits) for c in columns})


def _of_probabilities(name: str, score: Callable[[Column, Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.logits(spark, sf_dir).select("example_id", "step", steady(score(fn.softmax(F.col("z")), F.col("label"))).alias(name))

    QUERIES[name] = run


_of_probabilities("entropy", lambda p, y: fn.entropy(p))
_of_probabilities("class_confidence", fn.class_confidence)
_of_probabilities("max_confidence", lambda p, y: fn.max_confidence(p))
_of_probabilities("margin", lambda p, y: fn.once(p, lambda q: fn.margin(q, y)))
_of_probabilities("el2n", fn.error_l2_norm)
QUERIES |= {n: (lambda s, d, f=QUERIES[n], n=n, m=m: f(s, d).withColumnRenamed(n, m)) for n, m in (("entropy", "ent"), ("class_confidence", "conf"), ("max_confidence", "maxconf"))}


@query
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.logits(spark, sf_dir).select("example_id", "step", F.posexplode(fn.softmax(F.col("z"))).alias("class_idx", "p"))
    return rounded(df, "p")


@query
def zero_one_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.trajectory(spark, sf_dir)


@query
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logits(spark, sf_dir).select("example_id", "step", steady(fn.cross_entropy(F.col("z"), F.col("label"))).alias("cross_entropy"))


@query
def pointwise_metrics_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.pointwise(spark, sf_dir, loss=True), *DOUBLES, "loss")


QUERIES["pointwise_metrics"] = QUERIES.pop("pointwise_metrics_")


@query
def evaluate_linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, w = fx.images(spark, sf_dir), fx.weights(spark)
    df = evaluate(rows, lambda e: gradient.linear_logits(e, w).join(e.select("example_id", "label"), "example_id"), loss=fn.cross_entropy)
    return df.select("example_id", "step", "acc", steady(F.col("loss")).alias("loss"))


@query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doubles(F.col("x"))
    return fx.images(spark, sf_dir).select("example_id", *[steady(p_norm(x, o)).alias(n) for n, o in (("l2", None), ("linf", float("inf")), ("l3", 3))])


@query
def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.images(spark, sf_dir).select("example_id", F.posexplode(one_hot(F.col("label"), F.lit(fx.CLASSES))).alias("class_idx", "hot"))


@query
def mean_color_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, size = doubles(F.col("x")), fx.DIM // fx.CHANNELS
    mean = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: sum((F.get(F.col("x"), i + c * size) for c in range(1, fx.CHANNELS)), F.get(F.col("x"), i)) / fx.CHANNELS)
    return rounded(fx.images(spark, sf_dir).withColumn("x", x).select("example_id", F.posexplode(mean).alias("pixel", "mean")), "mean")


@query
def mean_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.images(spark, sf_dir).select("example_id", steady(total(doubles(F.col("x"))) / F.size("x")).alias("mean"))


@query
def forgetting_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forgetting.edges(fx.ragged(spark, sf_dir), ["example_id"], False).select("example_id", "step", "acc", "forgot")


@query
def learning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forgetting.edges(fx.ragged(spark, sf_dir), ["example_id"], False).select("example_id", "step", "acc", "learned")


def _event_time(name: str, score: Callable[[], Column]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fx.ragged(spark, sf_dir).groupBy("example_id").agg(score().cast("long").alias(name.replace("_", "")))


_event_time("first_learn", forgetting.first_learn)
_event_time("first_forget", forgetting.first_forget)
_event_time("first_unforgettable", forgetting.first_unforgettable)
_event_time("first_unlearnable", forgetting.first_unlearnable)


@query
def last_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = forgetting.edges(fx.ragged(spark, sf_dir), ["example_id"], False)
    return marked.groupBy("example_id").agg(forgetting.last_event(F.col("forgot")).cast("long").alias("last_forget"))


def _forget(source: str, start_at_zero: bool, *columns: str) -> Query:
    return lambda spark, sf_dir: forgetting.forget_metrics(getattr(fx, source)(spark, sf_dir), ["example_id"], start_at_zero).select("example_id", *(columns or ["*"]))


QUERIES |= {
    "count_forgetting_from0": _forget("ragged", True, "countforget"), "count_forgetting_from1": _forget("ragged", False, "countforget"),
    "is_unforgettable_from0": _forget("ragged", True, "unforgettable"), "is_unforgettable_from1": _forget("ragged", False, "unforgettable"),
}


@query
def forget_metrics_from0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forgetting.forget_metrics(fx.trajectory(spark, sf_dir), ["example_id"], True)


@query
def forget_metrics_from1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forgetting.forget_metrics(fx.trajectory(spark, sf_dir), ["example_id"], False)


@query
def forget_metrics_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forgetting.forget_metrics(fx.ragged(spark, sf_dir), ["example_id"], True)


@query
def mean_over_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.average_metrics(_numbers(fx.pointwise(spark, sf_dir)), ["example_id"], list(METRICS)), *[f"avg_{m}" for m in METRICS])


@query
def variance_over_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.variance_metrics(_numbers(fx.pointwise(spark, sf_dir)), ["example_id"], list(METRICS)), *[f"var_{m}" for m in METRICS])


@query
def online_pointwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.online_pointwise(_numbers(fx.pointwise(spark, sf_dir)), ["label"], list(METRICS))
    return rounded(found, *[f"{p}_{m}" for p in ("avg", "var") for m in METRICS])


@query
def resume_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of two models' runs, merged: as an accumulator that was saved and resumed."""
    rows, keys = fx.metrics(spark, sf_dir), ["metric", "example_id"]
    halves = [aggregates.moment_state(rows.where(c), keys, "value") for c in (F.col("model") == "m0", F.col("model") == "m1")]
    merged = aggregates.finish_moments(aggregates.merge_moments(halves[0].unionByName(halves[1]), keys))
    return rounded(merged.drop("m2"), "mean", "variance")


@query
def last_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.last_metrics(fx.pointwise(spark, sf_dir), ["example_id"], list(DOUBLES)), *[f"last_{m}" for m in DOUBLES])


def _numbers(df: DataFrame) -> DataFrame:
    return df.withColumn("acc", F.col("acc").cast("int"))


@query
def ensemble_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.votes(spark, sf_dir).groupBy("example_id").agg(ensemble.ensemble_accuracy().alias("allacc")), "allacc")


@query
def always_never_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.votes(spark, sf_dir).groupBy("example_id").agg(ensemble.always_learned().alias("always"), ensemble.never_learned().alias("never"))


@query
def ddd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.votes(spark, sf_dir).groupBy("example_id").agg(ensemble.dichotomy().alias("ddd"))


@query
def consensus_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.consensus_labels(fx.votes(spark, sf_dir), ["example_id"])


@query
def ensemble_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensemble.ensemble_metrics(fx.votes(spark, sf_dir), ["example_id"]), "allacc")


def _steady_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values rounded to 9 digits, so that ties do not depend on the last bits of a sum."""
    return fx.metrics(spark, sf_dir).withColumn("value", F.round("value", 9))


@query
def rank_avg_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.rank_average(_steady_metrics(spark, sf_dir), RUN, "value").drop("value", "is_train"), "rank")


@query
def rank_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks with many ties."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").alias("v"))
    return ranking.rank_average(rows, ["event_type"], "v").drop("event_type", "v")


@query
def argsort_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of every run's examples by every metric."""
    return ranking.argsort(_steady_metrics(spark, sf_dir), RUN, "value", "example_id")


@query
def order_to_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the classes by logit, an array a row, and the inverse permutations."""
    by_logit = F.array_sort(F.transform("z", lambda v, i: F.struct(F.round(v, 9).alias("v"), i.alias("i"))))
    orders = fx.logits(spark, sf_dir).select(F.col("example_id").alias("row_id"), "step", F.transform(by_logit, lambda s: s["i"]).alias("order"))
    return ranking.order_to_rank(orders, "order", ["row_id", "step"]).withColumnRenamed("example_id", "class_idx")


def _bins(metrics: DataFrame) -> DataFrame:
    means = metrics.groupBy("model", "metric", "example_id").agg(F.round(F.avg("value"), 9).alias("value"))
    return ranking.rank_bins(means, ["model", "metric"], "value", "example_id")


@query
def rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(fx.metrics(spark, sf_dir)).drop("value")


@query
def binned_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.metrics(spark, sf_dir)
    found = ranking.binned_quantiles(rows, _bins(rows), ["model", "metric"], "example_id", "value", tie="replicate", flags=F.col("metric") == "acc")
    return rounded(found, "mean", "median", "low", "high")


@query
def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = layers.select_layers(fx.activations(spark, sf_dir), include=["out", "block2"], exclude=["block3"])
    return kept.groupBy("layer_idx").agg(F.count("*").alias("n"))


@query
def distinct_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.distinct_layers(fx.activations(spark, sf_dir, copy=True))


@query
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representation.knn_predict(fx.activations(spark, sf_dir))


@query
def knn_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.activations(spark, sf_dir)
    return representation.knn_predict(rows.where("example_id % 5 <> 0"), rows.where("example_id % 5 = 0"))


@query
def prediction_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representation.prediction_depth(fx.activations(spark, sf_dir))


@query
def prediction_depth_softmax_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representation.prediction_depth(representation.append_softmax(fx.activations(spark, sf_dir), _outputs(spark, sf_dir)))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logits(spark, sf_dir).where(F.col("step") == fx.STEPS - 1).select("example_id", "label", "z")


@query
def representation_metrics_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen layers and the softmax for the depth of a test set, another layer for prototypes, pointwise scores."""
    rows, outputs = fx.activations(spark, sf_dir), _outputs(spark, sf_dir)
    train, test = (lambda df: df.where("example_id % 5 <> 0")), (lambda df: df.where("example_id % 5 = 0"))
    found = representation.representation_metrics(
        train(rows), k=15, layers=[0, 2, 3], proto_layer=1, outputs=train(outputs), softmax_layer=True, test=test(rows), test_outputs=test(outputs), pointwise=True
    )
    return rounded(found, "proto", *DOUBLES)


@query
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest of given centres: the classes' means."""
    last = fx.activations(spark, sf_dir).where(F.col("layer_idx") == fx.LAYERS - 1)
    centers = [r["center"] for r in representation.centroids(last).collect()]  # classes: tens
    return rounded(representation.center_distances(last, np.array(centers), out="nearest"), "nearest")


@query
def supervised_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = fx.activations(spark, sf_dir).where(F.col("layer_idx") == fx.LAYERS - 1)
    return rounded(representation.supervised_prototypes(last), "proto")


@query
def self_supervised_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = fx.activations(spark, sf_dir).where(F.col("layer_idx") == fx.LAYERS - 1)
    return representation.self_supervised_prototypes(last, k=10)


@query
def representation_metrics_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and both prototype distances, the last layer's rows being moved apart into two groups that clustering finds."""
    far = F.when(F.col("layer_idx") == fx.LAYERS - 1, F.col("label") % 2 * 100.0).otherwise(0.0)
    rows = fx.activations(spark, sf_dir)
    found = representation.representation_metrics(rows.withColumn("act", F.transform(doubles(F.col("act")), lambda x: x + far)), clusters=2)
    return rounded(found.select("example_id", "label", "proto", "selfproto", "pd"), "proto", "selfproto")


@query
def representation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(representation.representation_metrics(fx.activations(spark, sf_dir)), "proto")


def _gradients(spark: SparkSession, sf_dir: str, predicted: bool) -> DataFrame:
    df = gradient.input_gradient(fx.images(spark, sf_dir), fx.weights(spark), gradient.class_gradient, predicted)
    return rounded(df.select("example_id", F.posexplode("grad").alias("pos", "grad")), "grad")


@query
def input_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, False)


@query
def input_gradient_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, True)


@query
def input_gradient_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gradient.input_gradients(fx.images(spark, sf_dir), fx.weights(spark), gradient.loss_gradient)
    return rounded(df.select("example_id", "step", F.posexplode("grad").alias("pos", "grad")), "grad")


@query
def variance_of_gradients_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gradient.variance_of_gradients(fx.images(spark, sf_dir), fx.weights(spark), fx.CHANNELS, gradient.class_gradient), "vog", digits=9)


@query
def variance_of_gradients_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gradient.variance_of_gradients(fx.images(spark, sf_dir), fx.weights(spark), fx.CHANNELS, gradient.loss_gradient), "vog", digits=9)


@query
def online_variance_of_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel states of two groups of checkpoints, merged."""
    rows, w = fx.images(spark, sf_dir), fx.weights(spark)
    parts = [gradient.pixel_states(rows, w.where(c), fx.CHANNELS) for c in (F.col("step") < 2, F.col("step") >= 2)]
    merged = aggregates.finish_moments(aggregates.merge_moments(parts[0].unionByName(parts[1]), ["example_id", "pixel"]))
    return rounded(merged.groupBy("example_id").agg(F.avg("variance").alias("vog")), "vog", digits=9)


@query
def grand_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gradient.grand_score(fx.images(spark, sf_dir), fx.weights(spark)), "grand")


@query
def layered_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and loss of models with hidden layers."""
    df = evaluate(fx.images(spark, sf_dir), lambda e: layered.logits(e, fx.layered(spark)), loss=fn.cross_entropy)
    return df.select("example_id", "step", "acc", steady(F.col("loss")).alias("loss"))


@query
def layered_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named layers of every checkpoint."""
    df = layered.activations(fx.images(spark, sf_dir), fx.layered(spark), ["fc0_relu.out", "fc1.out"])
    return rounded(df.select("example_id", "step", "layer_idx", "layer", F.posexplode("act").alias("pos", "act")), "act")


@query
def discovered_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a model that no earlier layer equals, told by the given examples."""
    return layered.discover_layers(spark, fx.layered(spark), exclude=["fc2.in"], inputs=fx.images(spark, sf_dir).select("example_id", "x"))


@query
def layered_input_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layered.input_gradient(fx.images(spark, sf_dir), fx.layered(spark))
    return rounded(df.select("example_id", "step", F.posexplode("grad").alias("pos", "grad")), "grad", digits=9)


@query
def layered_grand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layered.grand_score(fx.images(spark, sf_dir), fx.layered(spark)).drop("label"), "grand")


@query
def layered_variance_of_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layered.variance_of_gradients(fx.images(spark, sf_dir), fx.layered(spark), fx.CHANNELS, layered.loss_error, predicted=True)
    return rounded(df.drop("label"), "vog", digits=9)


@query
def combine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = combine.combine_metrics(fx.metrics(spark, sf_dir))
    return rounded(df, *df.columns[3:])


@query
def is_train_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.metrics(spark, sf_dir)
    bad = combine.train_violations(rows).groupBy("model", "metric").agg(F.count("*").alias("violations"))
    return rounded(combine.train_counts(rows).join(bad, ["model", "metric"], "left").fillna(0, ["violations"]), "mean")


@query
def average_over_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.average_over_replicates(fx.metrics(spark, sf_dir), list(METRICS)), *METRICS)


@query
def outer_union_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training values of one model where there are any, else those of the other, run by run."""
    rows = fx.metrics(spark, sf_dir)
    part = lambda c: rows.where(c).select("replicate", "metric", "example_id", "value")
    a, b = part("model = 'm0' and is_train"), part("model = 'm1'")
    return rounded(combine.outer_union(a, b, ["replicate", "metric", "example_id"], ["value"]), "value")


@query
def metric_correlation_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.replicate_correlations(fx.metrics(spark, sf_dir), list(METRICS)), "corr")


@query
def metric_correlation_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.replicate_correlations(_steady_metrics(spark, sf_dir), list(METRICS), by_rank=True), "corr")


@query
def correlation_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.correlation_shrink(fx.metrics(spark, sf_dir), list(METRICS)), "corr_of_avg", "corr", "shrink")


@query
def correlation_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.correlation_of_averages(fx.metrics(spark, sf_dir), list(METRICS), median=True), "corr_of_avg")


@query
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.permutation_test(fx.metrics(spark, sf_dir)), "stat", "p")


@query
def permutation_test_per_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.permutation_test_per_example(fx.metrics(spark, sf_dir)), "stat", "p", "nlogp")


@query
def permutation_test_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians instead of means, and the greatest magnitude as the norm."""
    return rounded(analysis.permutation_test(fx.metrics(spark, sf_dir), median=True, order=float("inf")), "stat", "p")


def _three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.metrics(spark, sf_dir, replicates=2).withColumn("value", F.round("value", 9))


@query
def permutation_test_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of three models, values replaced by ranks."""
    return rounded(analysis.permutation_test(analysis.ranked(_three_models(spark, sf_dir))), "stat", "p")


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.standardize(_three_models(spark, sf_dir), RUN, "value").withColumn("value", F.col("scaled")).drop("scaled")


@query
def permutation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of three models, standardised values, over all metrics at once."""
    return rounded(analysis.permutation_summary(_scaled(spark, sf_dir)), "stat", "p")


@query
def permutation_per_example_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.permutation_test_per_example(_scaled(spark, sf_dir), over_metrics=True), "stat", "p", "nlogp")


@query
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.standardize(fx.metrics(spark, sf_dir), RUN, "value").select(*RUN, "example_id", "scaled"), "scaled")


@query
def pca_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.pca_explained_variance(fx.metrics(spark, sf_dir), list(DOUBLES)), "ratio", "cumulative")


@query
def split_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("label"), F.col("vec_id").alias("example_id"))
    return frames.split_batches(rows, ["label"], "example_id", 15)


@query
def batch_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as items, seven interleaved minibatches of events."""
    rows = fx.table(spark, sf_dir, "events").select((F.col("event_id") % 7).alias("batch"), "user_id", "event_id", "value")
    return rounded(frames.accumulate_batches(rows, "batch", "user_id", "event_id", "value"), "mean")


@query
def correlation_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix behind the heat map: correlations of averages, the diagonal masked."""
    return rounded(frames.zero_diagonal(analysis.correlation_of_averages(fx.metrics(spark, sf_dir), list(METRICS)), "metric_a", "metric_b", "corr_of_avg"), "corr_of_avg")


@query
def apply_to_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.apply_all(fx.pointwise(spark, sf_dir).select("example_id", "step", *DOUBLES), list(DOUBLES), lambda c: steady(c * 100, 3), "pct")


@query
def known_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.metrics(spark, sf_dir).groupBy("model", "metric").agg(F.count("*").alias("n"))
    return frames.order_known(counts, [("m1", "second"), ("m9", "absent")], "model")


@query
def one_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checkpoint of one model, selected by its keys."""
    rows = frames.select_checkpoint(fx.metrics(spark, sf_dir), model="m1", replicate=2, metric="ent")
    return rounded(rows.select("example_id", "value"), "value")


def _drained(spark: SparkSession, sf_dir: str, scores: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Scores of the events as a stream in three parts: steps are numbered before they arrive."""
    folder, parts = fx.stream_of(spark, fx.ragged(spark, sf_dir))
    return online.drain_parts(spark, folder, parts, STEP_ROWS, scores, mode)


@query
def stream_event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, online.event_times, "complete")


@query
def stream_forget_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, online.forget_scores, "update")


STEP_ROWS = "example_id LONG, step LONG, acc BOOLEAN"


def _late(spark: SparkSession, sf_dir: str) -> tuple[str, list[DataFrame]]:
    """Steps in three parts that each have every third of them, whatever their order."""
    folder, parts = fx.stream_of(spark, fx.ragged(spark, sf_dir), deal=(F.col("step") * 7 + F.col("example_id")) % 3)
    return folder, parts


@query
def stream_forget_metrics_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that arrive in no order, a part of them twice."""
    folder, parts = _late(spark, sf_dir)
    return online.drain_parts(spark, folder, [parts[2], parts[0], parts[1].unionByName(parts[2])], STEP_ROWS, online.forget_scores)


@query
def stream_segments_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the state holds when two of three parts have come, read back as a table."""
    folder, parts = _late(spark, sf_dir)
    online.drain_parts(spark, folder, [parts[1], parts[0]], STEP_ROWS, online.forget_scores)
    return online.read_state(spark, online.results_folder(folder))


@query
def stream_from_saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the later steps that starts from the saved summary of the earlier ones."""
    saved, (folder, parts) = _folder(spark, "segments"), fx.stream_of(spark, fx.ragged(spark, sf_dir))
    metrics.save_state(segments.segments_of(parts[0]), saved, "segments", {"parts": 1})
    state, _, _ = metrics.load_state(spark, saved, "segments")
    return online.drain_parts(spark, folder, [parts[2], parts[1]], STEP_ROWS, lambda s: online.forget_scores(s, saved=state))


@query
def trajectory_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of steps without those whose number three divides."""
    return segments.segments_of(fx.ragged(spark, sf_dir).where("step % 3 <> 0"))


def _checkpoints(spark: SparkSession, rows: DataFrame, drawn: Callable[[DataFrame], DataFrame], mode: str = "update") -> DataFrame:
    """Scores of a table with a step, whose checkpoints arrive two at a time, the last ones first."""
    held = cut(rows)
    parts = [held.where(F.col("step").isin(*steps)) for steps in ((5, 0), (3, 4), (1, 2))]
    return online.drain_parts(spark, _folder(spark, "checkpoints"), parts, ", ".join(f"{c} {kind}" for c, kind in held.dtypes), drawn, mode)


@query
def stream_online_pointwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and variances of every score over checkpoints that arrive as a stream."""
    found = _checkpoints(spark, _numbers(fx.pointwise(spark, sf_dir)), lambda s: accumulators.pointwise_moments(s, list(METRICS)), "complete")
    return rounded(found, *[f"{p}_{m}" for p in ("avg", "var") for m in METRICS])


@query
def stream_ensemble_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the runs of an ensemble that arrive as a stream."""
    return rounded(_checkpoints(spark, fx.votes(spark, sf_dir).withColumnRenamed("replicate", "step"), accumulators.vote_scores), "allacc")


@query
def stream_variance_of_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of checkpoints that arrive as a stream, channel by channel averaged before."""
    grads = gradient.channel_means(gradient.input_gradients(fx.images(spark, sf_dir), fx.weights(spark)), fx.CHANNELS)
    return rounded(accumulators.variance_of_gradients(_checkpoints(spark, grads, lambda s: accumulators.array_moments(s, "grad"))), "vog", digits=9)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def metric_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written to folders and two of them read back."""
    folder = _folder(spark, "metrics")
    metrics.write_metrics(fx.metrics(spark, sf_dir), folder)
    rows, _ = metrics.read_metrics(spark, folder)
    return rounded(rows.where("model = 'm1' and metric in ('ent', 'margin')").select(*RUN, "example_id", "value", "is_train"), "value")


@query
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and runs as a listing of their files tells them."""
    folder = _folder(spark, "metrics")
    metrics.write_metrics(fx.metrics(spark, sf_dir), folder)
    files = metrics.list_metric_files(spark, folder, include=["part"], suffix=".parquet")
    return files.select(*[F.regexp_extract("path", f"{c}=([^/]*)", 1).alias(c) for c in RUN]).distinct()


@query
def checkpoints_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "checkpoints")
    fx.trajectory(spark, sf_dir).write.partitionBy("step").parquet(folder)
    return metrics.list_checkpoints(spark, folder).where(F.size("files") > 0).select("step")


@query
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export table as CSV, read back."""
    folder, shown = _folder(spark, "csv"), ["all_mean", "train_median"]
    wide = combine.export_wide(combine.combine_metrics(fx.metrics(spark, sf_dir), ["metric", "example_id"]), list(METRICS), shown)
    metrics.write_csv(wide, folder)
    back = spark.read.option("header", True).schema(wide.schema).csv(folder)
    return back.select("example_id", *[steady(F.col(f"`{c}.{m}`")).alias(f"{c}_{m}") for m in METRICS for c in shown])


@query
def runs_of_a_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the runs that a table of parameters selects."""
    folder, rows = _folder(spark, "hparams"), fx.metrics(spark, sf_dir).withColumn("run", F.concat_ws("_", "model", "replicate"))
    table = rows.select("run", "model", "replicate").distinct().select(F.format_string("/runs/%s.pt", "run").alias("path"), F.col("model").alias("model_name"), (F.col("replicate") != 2).alias("custom_train_test_split"))
    metrics.write_csv(table, folder)
    chosen = combine.runs_of(metrics.read_hparams(spark, folder), "m1")
    return combine.restrict_to_runs(rows, chosen, ["run"]).groupBy("run").agg(F.count("*").alias("n"))


@query
def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An accumulator's state of half the runs saved, loaded and merged with the other half's."""
    folder, rows, keys = _folder(spark, "state"), fx.metrics(spark, sf_dir), ["metric", "example_id"]
    metrics.save_state(aggregates.moment_state(rows.where("model = 'm0'"), keys, "value"), folder, "variance", {"models": 1}, {"seen": ["m0"]})
    state, meta, lists = metrics.load_state(spark, folder, "variance")
    rest = rows.where(~F.col("model").isin(*lists["seen"][: meta["models"]]))
    merged = aggregates.merge_moments(state.unionByName(aggregates.moment_state(rest, keys, "value")), keys)
    return rounded(aggregates.finish_moments(merged).drop("m2"), "mean", "variance")


@query
def array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the bytes of array files, decoded."""
    files = arrays.encoded(fx.table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("embedding")), ["vec_id"], "embedding")
    return rounded(arrays.decoded(files, keys=("vec_id",)), "value")


@query
def published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the examples by five scores, published as array files and read under their choices, as ranks."""
    root, scores = _folder(spark, "published"), dict(zip(("adv", "agr", "conf", "priv", "ret"), DOUBLES, strict=True))
    rows = _steady_metrics(spark, sf_dir).where("model = 'm0' and replicate = 0")
    placed = cut(ranking.argsort(rows, RUN, "value", "example_id"))
    for key, score in scores.items():
        arrays.publish(placed.where(F.col("metric") == score).select(F.col("rank").alias("pos"), "example_id"), root, "order", metric=key, dataset="cifar10")
    return arrays.read_orders(spark, root, "cifar10")


@query
def published_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four aligned arrays of one file, written by many tasks and read by ranges of rows."""
    root, x = _folder(spark, "published"), lambda i: F.get("x", F.lit(i)).cast("double")
    rows = fx.images(spark, sf_dir).select(F.col("example_id").alias("pos"), F.col("example_id").alias("tr_idx"), (F.col("example_id") * 7 % 10).alias("tt_idx"), x(0).alias("infl"), x(1).alias("mem"))
    arrays.publish(rows, root, "influence")
    return rounded(arrays.published(spark, root, "influence", partition_rows=64, dataset="cifar100").where("pos >= 10"), "infl", "mem")


@query
def published_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memorization and prototype distances as published files, joined by example."""
    root, x = _folder(spark, "published"), lambda i: F.get("x", F.lit(i)).cast("double").alias("value")
    rows = fx.images(spark, sf_dir).withColumnRenamed("example_id", "pos")
    arrays.publish(rows.select("pos", x(2)), root, "memorization", dataset="cifar100")
    arrays.publish(rows.select("pos", x(3)), root, "prototypes", dataset="cifar100")
    one, two = arrays.read_memorization(spark, root, "cifar100"), arrays.read_prototype_distances(spark, root, "cifar100")
    return rounded(one.withColumnRenamed("value", "memorization").join(two.withColumnRenamed("value", "distance"), "example_id"), "memorization", "distance")


@query
def stacked_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.trajectory(spark, sf_dir)
    return aggregates.stack_metrics({t: rows.where(F.col("step") == t).drop("step") for t in range(fx.STEPS)})


@query
def appended_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.trajectory(spark, sf_dir)
    return frames.append_rows([rows.where(F.col("step") == t) for t in range(fx.STEPS)])


@query
def first_rows_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts appended, and of them the three quarters that come first by their order."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", "value")
    parts = [rows.where(F.col("event_id") % 3 == i) for i in range(3)]
    return rounded(frames.append_rows(parts, rows.count() * 3 // 4, "event_id"), "value")


def _view(rows: DataFrame) -> str:
    name = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    return name


@query
def sql_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score by SQL text over registered functions."""
    register_functions(spark)
    shown = ", ".join(f"round({f}, 6) + 0D AS {m}" for m, f in (("ent", "entropy(p)"), ("conf", "class_confidence(p, label)"), ("maxconf", "max_confidence(p)"), ("margin", "margin(p, label)"), ("el2n", "error_l2_norm(p, label)"), ("loss", "cross_entropy(z, label)")))
    return spark.sql(f"SELECT example_id, label, step, zero_one_accuracy(z, label) AS acc, {shown} FROM (SELECT *, softmax(z) AS p FROM {_view(fx.logits(spark, sf_dir))})")


@query
def sql_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning and forgetting by SQL text over registered aggregates."""
    register_functions(spark)
    return spark.sql(f"SELECT example_id, count_forgetting(step, acc) AS countforget, unforgettable(step, acc) AS unforgettable, first_learned(step, acc) AS firstlearn FROM {_view(fx.ragged(spark, sf_dir))} GROUP BY example_id")


@query
def table_function_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the examples of every label, by a table function."""
    register_tables(spark)
    rows = fx.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("example_id"))
    return spark.sql(f"SELECT * FROM batches(TABLE({_view(rows)}) PARTITION BY label ORDER BY (example_id), 15)")


@query
def table_function_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every trajectory, by a table function."""
    register_tables(spark)
    return spark.sql(f"SELECT * FROM trajectory_events(TABLE({_view(fx.ragged(spark, sf_dir))}) PARTITION BY example_id ORDER BY step)")


@query
def bucketed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits joined to labels that are kept apart, both in buckets by example, and scored."""
    rows = fx.logits(spark, sf_dir)
    logits = bucketed.write_bucketed(rows.drop("label"), ["example_id"], buckets=8)
    labels = bucketed.write_bucketed(fx.images(spark, sf_dir).select("example_id", "label"), ["example_id"], buckets=8)
    return rounded(pointwise_metrics(bucketed.joined_in_buckets(spark, logits, labels, ["example_id"])), *DOUBLES)


@query
def observed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values brought to 0..1 by the range that the pass that wrote them saw."""
    table, seen = observed.write_checked_metrics(fx.metrics(spark, sf_dir), _folder(spark, "observed"))
    share = (F.col("value") - seen["least"]) / (seen["most"] - seen["least"])
    return rounded(table.select(*RUN, "example_id", share.alias("share"), (F.lit(seen["n_train"]) / seen["n"]).alias("train_share")), "share", "train_share")


@query
def replicates_of_a_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.select_replicates(fx.metrics(spark, sf_dir), model="m0", metric="conf").select("replicate", "example_id", "value"), "value")


@query
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.order_metrics(fx.metrics(spark, sf_dir))


@query
def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs of a model share training examples, and whether any two have the same or none in common."""
    return frames.key_overlaps(fx.metrics(spark, sf_dir).where("is_train"), ["model", "metric"], "replicate", ["example_id"])


@query
def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rename_all(fx.trajectory(spark, sf_dir), ["acc"], "np", "int")


@query
def layers_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named layers, whatever the patterns, and the modules they belong to."""
    kept = layers.select_layers(fx.activations(spark, sf_dir), include=["block0"], layers=["block1.out", "block2.in"])
    return kept.groupBy(layers.module_name(F.col("layer")).alias("module")).agg(F.count("*").alias("n"))
