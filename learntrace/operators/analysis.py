"""Cross-run statistics: correlation, permutation tests, principal components."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.operators.aggregates import standardize
from learntrace.operators.ranking import rank_average


EXAMPLES = 2_000  # whose differences are held at once


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are known; null where one of them is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ranked(metrics: DataFrame) -> DataFrame:
    """Values replaced by their tie-averaged ranks within model, replicate and metric."""
    return rank_average(metrics, ["model", "replicate", "metric"], "value", "_rank").withColumn("value", F.col("_rank")).drop("_rank")


def replicate_correlations(metrics: DataFrame, names: list[str], by_rank: bool = False) -> DataFrame:
    """model, metric_a, metric_b, corr: the mean over replicates of the correlation of two metrics; a metric
    with itself pairs replicate i with replicate i + half.

    Metrics are pivoted to columns by one shuffle and all pairs are aggregates of the same rows, so that
    no pair of metrics costs a join."""
    rows = ranked(metrics) if by_rank else metrics
    half = rows.agg(((F.max("replicate") + 1) / 2).cast("int")).first()[0]
    wide = rows.groupBy("model", "replicate", "example_id").pivot("metric", names).agg(F.first("value"))
    pairs = [(a, b) for a in names for b in names if a != b]
    cross = wide.groupBy("model", "replicate").agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    late = wide.where((F.col("replicate") >= half) & (F.col("replicate") < 2 * half)).select("model", (F.col("replicate") - half).alias("replicate"), "example_id", *[F.col(n).alias(f"_{n}") for n in names])
    self_ = wide.join(late, ["model", "replicate", "example_id"]).groupBy("model", "replicate").agg(*[correlation(n, f"_{n}").alias(f"{n}|{n}") for n in names])

    def long(df: DataFrame, cols: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c.split("|")[0]).alias("metric_a"), F.lit(c.split("|")[1]).alias("metric_b"), F.col(f"`{c}`").alias("corr")) for c in cols])
        return df.select("model", "replicate", F.explode(each).alias("s")).select("model", "s.*")

    found = long(cross, [f"{a}|{b}" for a, b in pairs]).unionByName(long(self_, [f"{n}|{n}" for n in names]))
    return found.groupBy("model", "metric_a", "metric_b").agg(F.avg("corr").alias("corr"))


def correlation_of_averages(metrics: DataFrame, names: list[str], median: bool = False) -> DataFrame:
    f = F.median if median else F.avg
    wide = metrics.groupBy("model", "example_id").pivot("metric", names).agg(f("value"))
    pairs = [(a, b) for a in names for b in names]
    got = wide.groupBy("model").agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"`{a}|{b}`").alias("corr_of_avg")) for a, b in pairs])
    return got.select("model", F.explode(each).alias("s")).select("model", "s.*")


def correlation_shrink(metrics: DataFrame, names: list[str], median: bool = False) -> DataFrame:
    """Correlation of the averages (or medians) less the average correlation."""
    both = correlation_of_averages(metrics, names, median).join(replicate_correlations(metrics, names), ["model", "metric_a", "metric_b"])
    return both.withColumn("shrink", F.col("corr_of_avg") - F.col("corr"))


def column_order(perm: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of run column ``c`` (from 1) in a permutation: an arithmetic hash that any engine can repeat."""
    return (perm * 7919 + c * 104729 + 1) * 48271 % 2147483647 * 16807 % 2147483647


@dataclass(frozen=True)
class Pairing:
    """Two models and the share that each run column has in either side's mean: a row a permutation, row 0 the truth."""

    model_a: str
    model_b: str
    side_a: np.ndarray  # (n + 1) x columns, 0 or 1
    side_b: np.ndarray


def pairings(runs: list[tuple[str, int]], n: int = 100) -> list[Pairing]:
    """Every pair of models with the true assignment and ``n`` random ones of both models' columns; the first
    side draws as many columns as the first model has. ``runs`` are sorted (model, replicate): tens of columns."""
    out, models = [], sorted({m for m, _ in runs})
    for i, a in enumerate(models):
        for b in models[i + 1 :]:
            own = np.array([k for k, (m, _) in enumerate(runs) if m in (a, b)])
            of_a = np.array([m == a for m, _ in runs])
            order = column_order(np.arange(n)[:, None], own[None, :] + 1)
            drawn = own[np.argsort(order, axis=1, kind="stable")][:, : of_a.sum()]
            side = np.zeros((n + 1, len(runs)), dtype=bool)
            side[0] = of_a
            np.put_along_axis(side[1:], drawn, True, axis=1)
            other = ~side
            other[:, np.setdiff1d(np.arange(len(runs)), own)] = False
            out.append(Pairing(a, b, side, other))
    return out


def _side_means(values: np.ndarray, side: np.ndarray, median: bool) -> np.ndarray:
    """Mean or median over the columns of each permutation's side, without missing values: rows x metrics x permutations."""
    if median:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # a side without values has no median
            return np.stack([np.nanmedian(values[:, :, s], axis=2) if s.any() else np.full(values.shape[:2], np.nan) for s in side], axis=2)
    weight, known = side.T.astype(float), ~np.isnan(values)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(known, values, 0.0) @ weight / (known @ weight)


def model_differences(metrics: DataFrame, fn: Callable[[Pairing, list[str], np.ndarray, np.ndarray], pd.DataFrame], schema: str, n: int = 100, median: bool = False) -> DataFrame:
    """``fn(pairing, metrics, example ids, differences)`` over batches of examples and every pair of models.

    One shuffle brings an example's values together, as many as runs times metrics; the differences of its sides'
    means, one for each permutation, are products with the permutations' matrix, so no row is copied for them."""
    spark = metrics.sparkSession
    places = sorted(tuple(r) for r in metrics.select("metric", "model", "replicate").distinct().collect())  # runs times metrics: hundreds
    names, runs = sorted({m for m, _, _ in places}), sorted({(m, r) for _, m, r in places})
    rows = [(m, x, r, names.index(m) * len(runs) + runs.index((x, r))) for m, x, r in places]
    if not rows:
        return spark.createDataFrame([], schema)
    table = F.broadcast(spark.createDataFrame(rows, "metric string, model string, replicate int, _at int"))
    wide = metrics.join(table, ["metric", "model", "replicate"]).groupBy("example_id").agg(F.collect_list(F.struct("_at", "value")).alias("v"))
    wide = wide.select("example_id", F.transform("v", lambda s: s["_at"]).alias("at"), F.transform("v", lambda s: s["value"]).alias("value"))
    pairs = pairings(runs, n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), EXAMPLES):
                part = frame.iloc[first : first + EXAMPLES]
                values = np.full((len(part), len(names) * len(runs)), np.nan)
                values[np.repeat(np.arange(len(part)), part["at"].map(len)), np.concatenate(part["at"].to_numpy())] = np.concatenate(part["value"].to_numpy())
                values = values.reshape(len(part), len(names), len(runs))
                for p in pairs:
                    yield fn(p, names, part["example_id"].to_numpy(), _side_means(values, p.side_a, median) - _side_means(values, p.side_b, median))

    return wide.mapInPandas(run, schema)


def permutation_norms(metrics: DataFrame, n: int = 100, median: bool = False, order: float | None = None) -> DataFrame:
    """model_a, model_b, metric, perm and ``power``, the sum over examples of the magnitudes of the differences to the
    power ``order`` (None: 2, infinity: the greatest magnitude); permutation -1 is the true assignment."""
    o = 2.0 if order is None else float(order)

    def powers(p: Pairing, names: list[str], ids: np.ndarray, diff: np.ndarray) -> pd.DataFrame:
        size = np.nan_to_num(np.abs(diff))
        found = size.max(axis=0) if np.isinf(o) else (size**o).sum(axis=0)
        perm = np.arange(-1, found.shape[1] - 1)
        return pd.DataFrame({"model_a": p.model_a, "model_b": p.model_b, "metric": np.repeat(names, len(perm)), "perm": np.tile(perm, len(names)), "power": found.ravel()})

    parts = model_differences(metrics, powers, "model_a string, model_b string, metric string, perm long, power double", n, median)
    return parts.groupBy("model_a", "model_b", "metric", "perm").agg((F.max if np.isinf(o) else F.sum)("power").alias("power"))


def permutation_test(metrics: DataFrame, n: int = 100, median: bool = False, order: float | None = None) -> DataFrame:
    """model_a, model_b, metric, stat (norm of the true differences) and p, the share of permutations with as large a norm."""
    return one_sided_p(permutation_norms(metrics, n, median, order), ["model_a", "model_b", "metric"], _norm(F.col("power"), order))


def permutation_summary(metrics: DataFrame, n: int = 100, median: bool = False, order: float | None = None) -> DataFrame:
    """model_a, model_b, stat and p over all metrics at once."""
    per = permutation_norms(metrics, n, median, order)
    total = F.max("power") if order == float("inf") else F.sum("power")
    return one_sided_p(per.groupBy("model_a", "model_b", "perm").agg(total.alias("power")), ["model_a", "model_b"], _norm(F.col("power"), order))


def _norm(power: Column, order: float | None) -> Column:
    if order == float("inf"):
        return power
    return F.sqrt(power) if order is None or order == 2 else F.pow(power, F.lit(1.0 / order))


def permutation_test_per_example(metrics: DataFrame, n: int = 100, median: bool = False, over_metrics: bool = False, digits: int = 9) -> DataFrame:
    """model_a, model_b, metric, example_id, stat (magnitude of the true difference), p and nlogp = -ln(p + 1e-8).

    ``over_metrics``: a row an example instead, whose stat is the L2 norm over all metrics."""
    def judged(p: Pairing, names: list[str], ids: np.ndarray, diff: np.ndarray) -> pd.DataFrame:
        size = np.sqrt(np.nansum(diff * diff, axis=1, keepdims=True)) if over_metrics else np.abs(diff)
        size = np.round(size, digits)
        with np.errstate(invalid="ignore"):
            share = (size[:, :, 1:] >= size[:, :, :1]).mean(axis=2) if n else np.full(size.shape[:2], np.nan)
        keys = {} if over_metrics else {"metric": np.tile(names, len(ids))}
        return pd.DataFrame({"model_a": p.model_a, "model_b": p.model_b, **keys, "example_id": np.repeat(ids, size.shape[1]), "stat": size[:, :, 0].ravel(), "p": share.ravel()})

    schema = f"model_a string, model_b string, {'' if over_metrics else 'metric string, '}example_id long, stat double, p double"
    return model_differences(metrics, judged, schema, n, median).withColumn("nlogp", -F.ln(F.col("p") + 1e-8))


def one_sided_p(nulls: DataFrame, keys: list[str], stat: Column, digits: int = 9) -> DataFrame:
    """Rows of permutation -1 hold the statistic; p is the share of the others that are as large.

    Statistics are compared rounded, or permutations that only rename the sides differ by noise."""
    s = F.round(stat, digits)
    per = nulls.select(*keys, "perm", s.alias("s")).groupBy(*keys).agg(F.max(F.when(F.col("perm") == -1, F.col("s"))).alias("stat"), F.collect_list(F.when(F.col("perm") != -1, F.col("s"))).alias("n"))
    return per.select(*keys, "stat", (F.size(F.filter("n", lambda x: x >= F.col("stat"))) / F.size("n")).alias("p"))


def pca_explained_variance(metrics: DataFrame, names: list[str], keep: float = 0.99) -> DataFrame:
    """model, component, ratio, cumulative, kept: explained variance of the standardised averages of each model's metrics."""
    means = metrics.groupBy("model", "metric", "example_id").agg(F.avg("value").alias("value"))
    wide = standardize(means, ["model", "metric"], "value").groupBy("model", "example_id").pivot("metric", names).agg(F.first("scaled")).dropna()
    wide = wide.select("model", array_to_vector(F.array(*names)).alias("v"))
    rows = []
    for (model,) in sorted(metrics.select("model").distinct().collect()):  # models: tens
        fitted, total = PCA(k=len(names), inputCol="v", outputCol="o").fit(wide.where(F.col("model") == model)), 0.0
        for i, r in enumerate(float(x) for x in fitted.explainedVariance):
            before, total = total, total + r
            rows.append((model, i, r, total, before <= keep))
    return metrics.sparkSession.createDataFrame(rows, "model string, component int, ratio double, cumulative double, kept boolean")
