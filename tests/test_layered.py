"""Layered models against finite differences, and their names and shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from learntrace.operators import gradient, layered
from learntrace.plans import fixtures as fx
from tests.conftest import SF


def network(rng, sizes=(7, 6, 5, 4)):
    return [layered.Layer(f"fc{i}", rng.normal(size=(n, m)), rng.normal(size=n), i < len(sizes) - 2) for i, (m, n) in enumerate(zip(sizes, sizes[1:], strict=False))]


def value(layers, x, y, loss):
    p = layered.softmax(layered.forward(layers, x[None])[-1][1])[0]
    return -np.log(p[y]) if loss else p[y]


@pytest.mark.parametrize("error,loss", [(layered.loss_error, True), (layered.confidence_error, False)])
def test_gradients_against_differences(error, loss):
    rng, eps = np.random.default_rng(3), 1e-6
    layers = network(rng)
    x, y = rng.normal(size=(5, 7)), rng.integers(0, 4, 5)
    by_input, norms = layered.backward(layers, x, y, error)
    for i in range(5):
        for j in range(7):
            step = np.eye(7)[j] * eps
            assert abs((value(layers, x[i] + step, y[i], loss) - value(layers, x[i] - step, y[i], loss)) / (2 * eps) - by_input[i, j]) < 1e-6
        squares = 0.0
        for layer in layers:
            for array in (layer.w, layer.b):
                for at in np.ndindex(array.shape):
                    old, ends = array[at], []
                    for sign in (1, -1):
                        array[at] = old + sign * eps
                        ends.append(value(layers, x[i], y[i], loss))
                    array[at] = old
                    squares += ((ends[0] - ends[1]) / (2 * eps)) ** 2
        assert abs(np.sqrt(squares) - norms[i]) < 1e-5


def test_one_layer_is_the_linear_model(spark):
    rows, w = fx.images(spark, SF), fx.weights(spark)
    model = w.groupBy("step").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "w"))), lambda s: s["w"])).alias("w"), F.collect_list("b").alias("b"))
    model = model.select("step", F.lit(0).alias("layer_idx"), F.lit("head").alias("name"), "w", "b", F.lit("none").alias("activation"))
    got = {r[0]: r["grand"] for r in layered.grand_score(rows, model).collect()}
    for r in gradient.grand_score(rows, w).collect():
        assert abs(got[r[0]] - r["grand"]) < 1e-9
    assert layered.variance_of_gradients(rows, model.where("step = 0"), 4).where("vog is not null").count() == 0


def test_names_layers_and_runs(spark):
    rows, model = fx.images(spark, SF), layered.gathered(fx.layered(spark))
    names = layered.module_names(model[0])
    assert names[:4] == ["fc0.in", "fc0.out", "fc0_relu.in", "fc0_relu.out"] and names[-1] == "fc2.out"
    found = [r["layer"] for r in layered.discover_layers(spark, fx.layered(spark), n=20).orderBy("layer_idx").collect()]
    assert found == ["fc0.in", "fc0.out", "fc0_relu.out", "fc1.out", "fc1_relu.out", "fc2.out"]
    assert [r["layer"] for r in layered.discover_layers(spark, model, include=["fc1"], exclude=["relu"]).orderBy("layer_idx").collect()] == ["fc1.in", "fc1.out"]
    runs = list(layered.activations_by_run(rows, model, found, 2))
    assert len(runs) == 3 and [r.select("layer").distinct().count() for r in runs] == [2, 2, 2]
    with pytest.raises(ValueError):
        layered.activations(rows, model, ["fc9.out"])


def test_models_that_do_not_fit(spark):
    schema = "step int, layer_idx int, name string, w array<double>, b array<double>, activation string"
    with pytest.raises(ValueError):
        layered.gathered(spark.createDataFrame([(0, 0, "a", [1.0, 2.0], [1.0], "none"), (0, 1, "b", [1.0, 2.0], [1.0], "none")], schema))
    with pytest.raises(ValueError):
        layered.gathered(spark.createDataFrame([(0, 0, "a", [1.0], [1.0], "tanh")], schema))
    assert layered.gathered(spark.createDataFrame([], schema)) == {}


def test_batches_do_not_matter_and_empty_tables(spark):
    rows, model = fx.images(spark, SF), fx.layered(spark)
    whole = {r[0]: r["grand"] for r in layered.grand_score(rows, model).collect()}
    few = {r[0]: r["grand"] for r in layered.grand_score(rows.where("example_id % 3 = 0").repartition(3), model).collect()}
    assert all(abs(whole[k] - v) < 1e-12 for k, v in few.items())
    assert layered.logits(rows.limit(0), model).count() == 0
