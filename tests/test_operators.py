import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from learntrace.functions import pointwise as fn
from learntrace.functions.vectors import argmax
from learntrace.operators import aggregates, analysis, combine, ensemble, frames, gradient, layers, neighbours, ranking, representation
from learntrace.operators.pointwise import pointwise_metrics
from learntrace.plans import fixtures as fx
from tests.conftest import SF


def scores(spark, z, label):
    return pointwise_metrics(spark.createDataFrame([(z, label)], "z array<double>, label int"), loss=True).first()


def test_scores_of_extreme_logits_stay_finite(spark):
    r = scores(spark, [1000.0, -1000.0], 0)
    assert (r["acc"], r["conf"], r["ent"], r["el2n"], r["loss"]) == (True, 1.0, 0.0, 0.0, 0.0)
    r = scores(spark, [0.0] * 4, 2)
    assert math.isclose(r["ent"], math.log(4)) and r["margin"] == 0 and not r["acc"]
    assert scores(spark, [3.0], 0)["margin"] == 1.0


def test_softmax_against_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 5, (30, 7))
    got = np.array([r[0] for r in spark.createDataFrame([(x.tolist(),) for x in z], "z array<double>").select(fn.softmax(F.col("z"))).collect()])
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(np.sort(got, axis=0), np.sort(e / e.sum(axis=1, keepdims=True), axis=0), atol=1e-12)


def test_argmax_takes_the_first(spark):
    assert spark.sql("select array(1.0D, 3.0D, 3.0D) as z").select(argmax(F.col("z"))).first()[0] == 1


def test_ranks_with_ties_nulls_and_one_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("a", None), ("b", 5.0)], "k string, v double")
    got = sorted((r["k"], -1 if r["v"] is None else r["v"], r["rank"]) for r in ranking.rank_average(df, ["k"], "v").collect() if r["v"] is not None)
    assert got == [("a", 1.0, 0.0), ("a", 2.0, 1.5), ("a", 2.0, 1.5), ("a", 3.0, 3.0), ("b", 5.0, 0.0)]


@pytest.mark.parametrize("n", [1, 2, 500])
def test_rank_bins_hold_the_top_row_alone(spark, n):
    df = spark.range(n).select(F.lit(0).alias("k"), F.col("id"), (F.col("id") * 1.5).alias("v"))
    bins = {r["bin"]: r["count"] for r in ranking.rank_bins(df, ["k"], "v", "id").groupBy("bin").count().collect()}
    assert sum(bins.values()) == n and (n < 2 or bins[99] == 1)


def test_order_is_the_inverse_of_rank(spark):
    got = ranking.order_to_rank(spark.createDataFrame([("m", [3, 1, 2])], "m string, o array<long>"), "o", ["m"]).collect()
    assert {r["example_id"]: r["rank"] for r in got} == {3: 0, 1: 1, 2: 2}


def test_moments_merge_with_a_high_bias(spark):
    rng = np.random.default_rng(1)
    x = 1e6 + rng.normal(0, 1, 400)
    df = spark.createDataFrame([(0, i % 3, float(v)) for i, v in enumerate(x)], "k int, part int, v double")
    states = aggregates.moment_state(df, ["k", "part"], "v").drop("part")
    r = aggregates.finish_moments(aggregates.merge_moments(states, ["k"])).first()
    assert r["n"] == 400 and math.isclose(r["variance"], x.var(ddof=1), rel_tol=1e-6) and math.isclose(r["mean"], x.mean())
    one = aggregates.finish_moments(aggregates.merge_moments(aggregates.moment_state(df.limit(1), ["k"], "v"), ["k"])).first()
    assert one["variance"] is None


def test_standardize_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "k string, v double")
    assert {r["scaled"] for r in aggregates.standardize(df, ["k"], "v").collect()} == {0.0}


def test_consensus_ties_go_to_the_smaller_label(spark):
    df = spark.createDataFrame([(0, 3, False), (0, 1, False), (0, 3, True), (0, 1, True), (0, 2, False)], "example_id int, pred int, acc boolean")
    assert ensemble.consensus_labels(df, ["example_id"]).first()["consensuslabel"] == 1
    assert ensemble.ensemble_metrics(df, ["example_id"]).first()["ddd"] == 0


def test_depth_of_the_shifted_points(spark):
    """Two training points in three layers; test points that move away by 0.2 a layer."""
    train = spark.createDataFrame([(i, n, n, [float(n)]) for i in range(3) for n in (0, 1)], "layer_idx int, example_id long, label int, act array<double>")
    test = spark.createDataFrame([(i, n, 1, [0.2 * n + 0.2 * i]) for i in range(3) for n in range(4)], "layer_idx int, example_id long, label int, act array<double>")
    got = {r["example_id"]: r["pd"] for r in representation.prediction_depth(train, test, k=1).collect()}
    assert got == {0: 3, 1: 2, 2: 1, 3: 0}
    assert {r["pd"] for r in representation.prediction_depth(train, k=1).collect()} == {0}


def test_blocks_do_not_change_neighbours(spark):
    rows = fx.activations(spark, SF).where("example_id < 60")
    key = ["layer_idx", "query_id", "train_id"]
    assert sorted(neighbours.nearest(rows, rows, 5).select(*key).collect()) == sorted(neighbours.nearest(rows, rows, 5, block_rows=7).select(*key).collect())


def clustered(spark, n=300, groups=6, dim=5, seed=3):
    """Tight groups far apart, a hot one, ties and a few rows between the groups."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 100, (groups, dim))
    of = np.where(rng.random(n) < 0.4, 0, rng.integers(0, groups, n))
    x = centre[of] + rng.normal(0, 1, (n, dim))
    x[10:20] = x[0:10]
    x[20:24] = centre.mean(axis=0)
    rows = [(layer, i, i % 3, (x[i] * (1 + layer)).tolist()) for layer in (0, 1) for i in range(n)]
    return x, spark.createDataFrame(rows, "layer_idx int, example_id long, label int, act array<double>")


@pytest.mark.parametrize("block_rows,k", [(1000, 5), (40, 5), (9, 30)])
def test_neighbours_of_clusters(spark, block_rows, k):
    x, rows = clustered(spark)
    queries = rows.where("example_id % 2 = 0")
    exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for asked in (rows, queries):
        got = {}
        for r in neighbours.nearest(rows, asked, k, block_rows).collect():
            got.setdefault((r["layer_idx"], r["query_id"]), []).append((r["d"], r["train_id"]))
        ids = range(300) if asked is rows else range(0, 300, 2)
        assert set(got) == {(layer, i) for layer in (0, 1) for i in ids}
        for (layer, i), found in got.items():
            want = sorted((exact[i, j] * (1 + layer), j) for j in range(300))[:k]
            assert np.allclose([d for d, _ in sorted(found)], [d for d, _ in want]) and {j for _, j in found} == {j for _, j in want}


def test_blocks_far_away_are_not_met(spark):
    _, rows = clustered(spark, groups=12, n=600)
    index = neighbours.Index(rows, rows, 25)
    blocks = sum(int(layer.blocks.sum()) for layer in index.layers.values())
    met = index.meetings(index.first(5), 5).count()
    pairs = sum(int(layer.blocks.sum() * layer.later_parts.sum()) for layer in index.layers.values())
    assert blocks > 40 and met < 0.3 * pairs
    queries = index._meet(index.first(5), 5, False).count()
    assert queries < 0.25 * 600 * blocks  # of 600 queries a layer and half of the blocks each


def test_vectors_without_a_distance_are_named(spark):
    good = [(0, i, 0, [float(i), 1.0]) for i in range(5)]
    schema = "layer_idx int, example_id long, label int, act array<double>"
    fine = spark.createDataFrame(good, schema)
    for bad in ([float("nan"), 1.0], [1.0, float("inf")], [1.0, None], None, [1.0]):
        rows = spark.createDataFrame([*good, (0, 9, 0, bad)], schema)
        for train, test in ((rows, None), (fine, rows)):
            with pytest.raises(ValueError, match="example 9|numbers"):
                representation.knn_predict(train, test, 3)
    assert representation.knn_predict(fine.limit(0), None, 3).count() == 0
    assert representation.knn_predict(fine, fine.limit(0), 3).count() == 0


def test_clusters_of_far_groups_are_their_means(spark):
    df = spark.createDataFrame([(i, i % 2, [float(100 * (i % 2)) + d, 0.0]) for i, d in enumerate([-1.0, -1.0, 1.0, 1.0])], "example_id long, label int, act array<double>")
    own = representation.supervised_prototypes(df).select("proto").collect()
    near = representation.self_supervised_prototypes(df, k=2).select("selfproto").collect()
    assert sorted(own) == sorted(near) == [(1.0,)] * 4


@pytest.mark.parametrize("grad,loss", [(gradient.class_gradient, False), (gradient.loss_gradient, True)])
def test_closed_forms_against_differences(grad, loss):
    rng = np.random.default_rng(2)
    w, b, x, y = rng.normal(0, 1, (2, 5, 6)), rng.normal(0, 1, (2, 5)), rng.normal(0, 1, (3, 6)), np.array([0, 4, 2])

    def value(x):
        p = gradient.probabilities(w, b, x)
        own = np.take_along_axis(p, np.broadcast_to(y, p.shape[:2])[:, :, None], 2)[:, :, 0]
        return -np.log(own) if loss else own

    got, h = grad(w, b, x, y), 1e-6
    for j in range(6):
        d = np.zeros_like(x)
        d[:, j] = h
        assert np.allclose((value(x + d) - value(x - d)) / (2 * h), got[:, :, j], atol=1e-7)


def test_identical_checkpoints_have_no_variance_of_gradients(spark):
    w = fx.weights(spark, 1)
    same = w.unionByName(w.withColumn("step", F.lit(1)))
    assert gradient.variance_of_gradients(fx.images(spark, SF), same, 4).agg(F.max("vog")).first()[0] < 1e-20


def test_layers(spark):
    df = fx.activations(spark, SF, copy=True)
    assert [r["layer"] for r in layers.distinct_layers(df).orderBy("layer_idx").collect()] == ["block0.in", "block1.out", "block2.in", "block3.out"]
    assert spark.sql("select 'a.out' as n").select(layers.module_name(F.col("n"))).first()[0] == "a"
    keep = lambda **k: spark.sql("select 'conv.in' as n").select(layers.match_key(F.col("n"), **k)).first()[0]
    assert keep() and keep(include=["conv"]) and not keep(include=["conv"], exclude=["in"]) and not keep(include=["fc"])


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(analysis.correlation("a", "b")).first()[0] is None


def test_pca_ratios_are_the_eigenvalues(spark):
    names = list(fx.METRICS[1:])
    found = analysis.pca_explained_variance(fx.metrics(spark, SF), names).orderBy("component").toPandas()
    assert set(found["model"]) == {"m0", "m1"}
    for model, got in found.groupby("model"):
        wide = combine.average_over_replicates(fx.metrics(spark, SF), names, model).toPandas()[names].to_numpy()
        e = np.sort(np.linalg.eigvalsh(np.corrcoef(wide.T)))[::-1]
        assert np.allclose(got["ratio"], e / e.sum(), atol=1e-9)
        assert got["kept"].sum() == np.searchsorted(np.cumsum(e / e.sum()), 0.99, side="right") + 1 or got["kept"].all()


def test_each_pair_of_models_is_tested_alone(spark):
    """Models a and b are alike and c is shifted; d has one run only."""
    rng = np.random.default_rng(2)
    rows = [(m, r, "x", i, float(rng.normal(0, 0.1) + (5 if m == "c" else 0))) for m, runs in (("a", 4), ("b", 4), ("c", 4), ("d", 1)) for r in range(runs) for i in range(20)]
    df = spark.createDataFrame(rows, "model string, replicate int, metric string, example_id long, value double")
    got = {(r["model_a"], r["model_b"]): r for r in analysis.permutation_test(df).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert got["a", "c"]["stat"] > 20 and got["a", "c"]["p"] < 0.1 and got["a", "b"]["stat"] < 1 and got["a", "b"]["p"] > 0.05
    sizes = {(p.model_a, p.model_b): (set(p.side_a.sum(axis=1)), set(p.side_b.sum(axis=1))) for p in analysis.pairings(sorted({(m, r) for m, r, *_ in rows}))}
    assert sizes["a", "d"] == ({4}, {1}) and sizes["a", "b"] == ({4}, {4})
    gone = analysis.permutation_test(df.where("not (model = 'b' and example_id < 5)")).collect()  # missing values count for neither side
    assert len(gone) == 6 and all(r["stat"] is not None for r in gone)
    assert analysis.permutation_test(df.limit(0)).count() == 0


def test_places_of_a_value_that_most_rows_share(spark):
    """A metric of two values: no window holds its rows, and every task has a range of them."""
    df = spark.range(0, 50_000, 1, 8).select(F.lit("acc").alias("metric"), F.col("id"), (F.col("id") % 10 == 0).cast("double").alias("v"))
    placed = ranking.order_position(df, ["metric"], "v", "id")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "row_number" in line for line in plan.splitlines())
    got = placed.toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(50_000)) and got["id"].tolist() == [i for i in range(50_000) if i % 10] + list(range(0, 50_000, 10))
    sizes = df.repartitionByRange(8, "metric", "v", "id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 3 * sizes.median()


def test_quantiles_are_interpolated(spark):
    rng = np.random.default_rng(3)
    x = [(k, i, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 37)) for i, v in enumerate(rng.integers(0, 9, n))] + [("c", 99, None)]
    got = {r["k"]: r for r in ranking.quantiles(spark.createDataFrame(x, "k string, i long, v double"), ["k"], "v", ["i"], {"q": 0.05, "m": 0.5}).collect()}
    for k in "abc":
        own = [v for key, _, v in x if key == k and v is not None]
        assert math.isclose(got[k]["q"], np.quantile(own, 0.05)) and math.isclose(got[k]["m"], np.median(own))


def test_neighbours_by_products_are_the_exact_ones():
    rng = np.random.default_rng(4)
    for scale in (1.0, 1e6):
        a, b = np.round(rng.normal(0, scale, (60, 3)), 1), np.round(rng.normal(0, scale, (200, 3)), 1)
        b[50:90] = b[:40]  # ties
        b += 1e5
        a += 1e5
        ids = rng.permutation(200)
        row, col, d = neighbours.closest(a, b, ids, 7)
        exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        want = [sorted(range(200), key=lambda j, i=i: (exact[i, j], ids[j]))[:7] for i in range(60)]
        assert row.tolist() == np.repeat(np.arange(60), 7).tolist() and col.tolist() == [j for w in want for j in w]
    assert neighbours.closest(a, b[:3], ids[:3], 7)[1].shape == (180,)


def test_combine_and_export(spark):
    rows = fx.metrics(spark, SF)
    wide = combine.export_wide(combine.combine_metrics(rows.where("model = 'm0'")), ["conf"], ["all_mean", "test_median"])
    assert wide.columns == ["example_id", "all_mean.conf", "test_median.conf"] and wide.count() == 500
    assert combine.train_violations(rows).isEmpty()
    hparams = spark.createDataFrame([("/x/abc.pt", "m0", True), ("/x/d.e.pt", "m0", False)], "path string, model_name string, custom_train_test_split boolean")
    assert [r["run"] for r in combine.runs_of(hparams, "m0").collect()] == ["abc"]
    assert combine.select_replicates(rows, model="m1", metric="acc").count() == 1500


def test_empty_tables(spark):
    rows = fx.metrics(spark, SF).limit(0)
    assert ranking.rank_average(rows, ["metric"], "value").count() == 0
    assert combine.combine_metrics(rows).count() == 0
    assert representation.knn_predict(fx.activations(spark, SF).limit(0)).count() == 0


def test_frames(spark):
    a, b = spark.range(5).withColumnRenamed("id", "k"), spark.range(3, 7).withColumnRenamed("id", "k")
    assert frames.same_keys(a, a, ["k"]) and not frames.same_keys(a, b, ["k"])
    assert not frames.disjoint_keys(a, b, ["k"]) and frames.disjoint_keys(a, b.where("k > 4"), ["k"])
    assert frames.append_rows([a, b], 6, "k").count() == 6
    with pytest.warns(UserWarning):
        assert frames.append_rows([a], 9, "k").count() == 5
    assert [r["metric"] for r in frames.order_metrics(fx.metrics(spark, SF)).collect()][:2] == ["maxconf", "margin"]


def test_layers_of_a_scorer(spark):
    def scorer(rows):
        parts = [rows.select(F.lit(i).alias("layer_idx"), F.lit(n).alias("layer"), "example_id", F.transform("x", f).alias("act")) for i, (n, f) in enumerate((("a.in", lambda x: x), ("a.out", lambda x: x * 2), ("b.in", lambda x: x * 2)))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    assert frames.find_layers(scorer, spark, 3) == ["a.in", "a.out"]
    assert frames.find_layers(scorer, spark, 3, exclude=["a.out"]) == ["a.in", "b.in"]


def test_rows_of_null_keys_have_ranks(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", 2.0), ("a", None), (None, 1.0)], "k string, v double")
    got = sorted(((r["k"] or "", r["v"] or 0.0, r["rank"]) for r in ranking.rank_average(df, ["k"], "v").collect()), key=str)
    assert got == [("", 1.0, 0.5), ("", 1.0, 0.5), ("", 3.0, 2.0), ("a", 0.0, None), ("a", 2.0, 0.0)]


def test_quantiles_of_groups_with_nulls(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, None), (None, 3, 3.0), ("a", 4, None), ("b", 5, 5.0)], "k string, i int, v double")
    got = {r["k"]: (r["n"], r["mean"], r["m"]) for r in ranking.quantiles(df, ["k"], "v", ["i"], {"m": 0.5}).collect()}
    assert got == {None: (3, 2.0, 2.0), "a": (1, None, None), "b": (1, 5.0, 5.0)}


def test_first_rows_of_appended_parts(spark):
    parts = [spark.range(0, 50, 1, 3), spark.range(50, 100, 1, 3)]
    assert sorted(r["id"] for r in frames.append_rows(parts, 60, "id").collect()) == list(range(60))
    with pytest.warns(UserWarning, match="100 rows"):
        assert frames.append_rows(parts, 200, "id").count() == 100
    runs = spark.createDataFrame([(1, i) for i in range(4)] + [(2, i) for i in range(4)] + [(3, 9)], "run int, k int").withColumn("g", F.lit("x"))
    got = {(r["run_a"], r["run_b"]): (r["n_both"], r["same"], r["disjoint"]) for r in frames.key_overlaps(runs, ["g"], "run", ["k"]).collect()}
    assert got == {(1, 2): (4, True, False), (1, 3): (0, False, True), (2, 3): (0, False, True)}


def test_closest_within_a_bound_measures_few_rows(monkeypatch):
    """A bound leaves the rows within it, ties at the bound too, and no row of the rest is sorted."""
    rng = np.random.default_rng(3)
    a, b, ids = rng.normal(size=(40, 5)), rng.normal(size=(3000, 5)), rng.permutation(3000)
    b[100:110] = b[7]  # ties
    row, col, d = neighbours.closest(a, b, ids, 9)
    for i in range(40):
        whole = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
        assert ids[col[row == i]].tolist() == ids[np.lexsort((ids, whole))[:9]].tolist()
    bound = np.array([d[row == i][4] for i in range(40)])
    row, col, near = neighbours.closest(a, b, ids, 9, bound)
    assert (np.bincount(row, minlength=40) == 5).all() and (near <= bound[row]).all()
    seen, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(len(keys[0])) or lexsort(keys))
    neighbours.closest(a, b, ids, 9, bound)
    assert sum(seen) < 300


@pytest.mark.parametrize("apart", [100.0, 1e6])
def test_groups_far_from_zero_measure_few_rows(monkeypatch, apart):
    """Two groups far apart: the k nearest are those of exact distances, and few rows are measured one by one."""
    rng = np.random.default_rng(3)
    b = rng.normal(size=(6000, 16)) * 0.25 + (np.arange(6000) % 2 * apart)[:, None]
    a, ids, measured, divmod_ = b[:200], np.arange(6000)[::-1].copy(), [], np.divmod
    monkeypatch.setattr(np, "divmod", lambda x, n: (measured.append(len(x)), divmod_(x, n))[1])
    row, col, d = neighbours.closest(a, b, ids, 30)
    assert sum(measured) < 0.15 * len(a) * len(b)
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    for i in range(len(a)):
        order = np.lexsort((ids, want[i]))[:30]
        assert col[row == i].tolist() == order.tolist() and d[row == i].tolist() == want[i][order].tolist()
