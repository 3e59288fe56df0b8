import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from learntrace.plans import fixtures as fx
from learntrace.sources import array_source, arrays, metrics
from learntrace.streaming import online
from tests.conftest import SF


def folder_of(root, family):
    folder = root / arrays.PUBLISHED[family].folder
    folder.mkdir(exist_ok=True)
    return folder


def test_orders(spark, tmp_path):
    for m in arrays.PUBLISHED["order"].choices["metric"]:
        np.save(folder_of(tmp_path, "order") / f"order_cifar_{m}_train.npy", np.array([2, 0, 1]))
    got = {r["example_id"]: r["rank"] for r in arrays.read_order(spark, str(tmp_path), "adv", "cifar10").collect()}
    assert got == {2: 0, 0: 1, 1: 2}
    assert arrays.read_orders(spark, str(tmp_path), "cifar10").count() == 15
    for bad in (("xyz", "cifar10"), ("adv", "svhn")):
        with pytest.raises(ValueError):
            arrays.read_order(spark, str(tmp_path), *bad)


def test_values_and_influence(spark, tmp_path):
    np.savez(folder_of(tmp_path, "memorization") / "memorization-cifar100-0.7.npz", np.array([0.5, 0.25]))
    assert [r["value"] for r in arrays.read_memorization(spark, str(tmp_path), "cifar100").orderBy("example_id").collect()] == [0.5, 0.25]
    with pytest.raises(ValueError):
        arrays.read_memorization(spark, str(tmp_path), "cifar10")
    np.savez(folder_of(tmp_path, "prototypes") / "selfproto-cifar10-swav.npz", np.arange(3.0))
    assert arrays.read_prototype_distances(spark, str(tmp_path), "cifar10").count() == 3
    np.savez_compressed(folder_of(tmp_path, "influence") / "cifar100_high_infl_pairs_infl0.15_mem0.25.npz", tr_idx=np.array([1, 2]), tt_idx=np.array([3, 4], dtype=np.int32), infl=np.array([0.1, 0.2]), mem=np.array([0.5, 0.6, 0.7]))
    assert sorted(map(tuple, arrays.read_influence(spark, str(tmp_path)).collect())) == [(0, 1, 3, 0.1, 0.5), (1, 2, 4, 0.2, 0.6), (2, None, None, None, 0.7)]
    with pytest.raises(ValueError):
        arrays.read_influence(spark, str(tmp_path), "cifar10")


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_ranges_members_and_filters(spark, tmp_path, save):
    x, y = np.arange(1000), np.random.default_rng(0).normal(size=(700, 3)).astype(">f4")
    path = str(tmp_path / "two.npz")
    save(path, x=x, y=y, flags=x % 3 == 0)
    df = array_source.read_arrays(spark, path, partition_rows=100)
    assert df.dtypes == [("pos", "bigint"), ("x", "bigint"), ("y", "array<double>"), ("flags", "boolean")]
    rows = df.orderBy("pos").collect()
    assert [r["x"] for r in rows] == x.tolist() and [r["y"] for r in rows[:700]] == y.astype(float).tolist() and {r["y"] for r in rows[700:]} == {None} and rows[3]["flags"]
    assert df.rdd.getNumPartitions() == (10 if save is np.savez else 1)
    part = array_source.read_arrays(spark, path, ["x"], 100).where("pos >= 250 and pos < 460 and x % 2 = 0")
    assert part.columns == ["pos", "x"] and sorted(r["x"] for r in part.collect()) == list(range(250, 460, 2))
    if save is np.savez:
        assert part.rdd.getNumPartitions() == 3
    assert array_source.read_arrays(spark, path, ["x"]).where("pos = 5").collect() == [(5, 5)]
    assert array_source.read_arrays(spark, path, ["x"]).where("pos > 5 and pos < 4").count() == 0
    with pytest.raises(ValueError):
        array_source.read_arrays(spark, path, ["z"])


@pytest.mark.parametrize("n", [0, 1, 12_345])
def test_files_are_written_by_many_tasks(spark, tmp_path, n):
    rows = spark.range(0, n, 1, 7).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("x"), F.when(F.col("id") != 4, F.sqrt("id")).alias("y"), (F.col("id") % 2 == 0).alias("even")).repartition(5)
    array_source.write_arrays(rows, str(tmp_path / "a.npz"))
    with np.load(tmp_path / "a.npz") as got:  # checks the checksums
        assert sorted(got.files) == ["even", "x", "y"]
        want = np.sqrt(np.arange(n, dtype=float))
        want[4:5] = np.nan
        assert np.array_equal(got["x"], np.arange(n) * 3) and np.array_equal(got["y"], want, equal_nan=True) and np.array_equal(got["even"], np.arange(n) % 2 == 0)
    assert array_source.read_arrays(spark, str(tmp_path / "a.npz"), ["x"]).count() == n
    array_source.write_arrays(rows.select("pos", "x"), f"file:{tmp_path}/b.npy")
    assert np.array_equal(np.load(tmp_path / "b.npy"), np.arange(n) * 3)
    assert [f for f in os.listdir(tmp_path) if "writing" in f] == []


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "a.npy")
    rows = spark.range(100).select(F.col("id").alias("pos"), F.col("id").alias("x"))
    array_source.write_arrays(rows, path)
    bad = rows.withColumn("x", F.when(F.col("pos") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("x") + 1))
    for broken in (bad, rows.where("pos <> 50"), rows.union(rows.limit(1)), rows.withColumn("x", F.nullif("x", F.lit(3)))):
        with pytest.raises(Exception, match="lost|written|outside|null"):
            array_source.write_arrays(broken, path)
        assert np.array_equal(np.load(path), np.arange(100)) and os.listdir(tmp_path) == ["a.npy"]
    with pytest.raises(Exception, match="already"):
        array_source.write_arrays(rows, path, overwrite=False)
    with pytest.raises(Exception, match="npy"):
        array_source.write_arrays(rows.withColumn("y", F.lit(1.0)), path)


def test_checksums_join():
    a, b = b"some bytes", bytes(range(256)) * 37
    assert array_source.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert array_source.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_metric_folders(spark, tmp_path):
    rows = fx.metrics(spark, SF)
    metrics.write_metrics(rows, str(tmp_path / "m"))
    back, runs = metrics.read_metrics(spark, str(tmp_path / "m"))
    assert back.count() == rows.count() and runs.count() == 36
    plan = back.where("metric = 'ent' and model = 'm0'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan
    (tmp_path / "f").mkdir()
    for n in ("run_a_metrics.pt", "run_b_metrics.pt", "other.txt"):
        (tmp_path / "f" / n).write_text("x")
    found = metrics.list_metric_files(spark, str(tmp_path / "f"), ["_b"]).collect()
    assert [r["parts"][:2] for r in found] == [["run", "b"]] and found[0]["parts"][2].endswith("run_b_metrics.pt")
    metrics.write_csv(back.limit(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    (tmp_path / "h.csv").write_text("path,model_name,custom_train_test_split\n/a/b.pt,m,true\n")
    assert metrics.read_hparams(spark, str(tmp_path / "h.csv")).first()["custom_train_test_split"] is True


def test_saved_states(spark, tmp_path):
    state = spark.createDataFrame([(1, 2.0)], "example_id long, mean double")
    meta, lists = {"meta_str": "x", "data_int": 3}, {"list_float": [0.5, 0.25]}
    metrics.save_state(state, str(tmp_path / "s"), "mean", meta, lists)
    back, m, li = metrics.load_state(spark, str(tmp_path / "s"), "mean")
    assert (m, li) == (meta, lists) and back.collect() == state.collect()
    with pytest.raises(ValueError):
        metrics.load_state(spark, str(tmp_path / "s"), "variance")
    with pytest.raises(ValueError):
        metrics.save_state(state, str(tmp_path / "s"), "mean", {"mean": 1})
    with pytest.raises(ValueError):
        metrics.parse_type("torch.float")
    assert metrics.rename_all(state, ["mean"], "avg", "float").dtypes == [("example_id", "bigint"), ("avg_mean", "float")]


def test_stream_resumes_where_it_ended(spark, tmp_path):
    steps = fx.ragged(spark, SF)
    schema = "example_id LONG, step LONG, acc BOOLEAN"
    part = steps.selectExpr("example_id", "cast(step as long) step", "acc")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    part.where("step < 10 and step <> 3 or step = 20").coalesce(1).write.mode("append").parquet(src)
    online.drain(online.forget_scores(online.read_steps(spark, src, "*.parquet", schema)), folder=out)
    part.where("step >= 8 or step % 2 = 1").coalesce(1).write.mode("append").parquet(src)  # steps before the last ones come again
    got = online.drain(online.forget_scores(online.read_steps(spark, src, "*.parquet", schema)), folder=out)
    from learntrace.operators.forgetting import forget_metrics

    want = forget_metrics(steps, ["example_id"], True)
    cols = ["example_id", "countforget", "unforgettable", "firstlearn", "firstunforgettable"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
