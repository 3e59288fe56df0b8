"""Functions, aggregates and table functions of the session, bucketed joins and observed checks."""

import warnings

import pytest
from pyspark.sql import functions as F

from learntrace.operators import observed
from learntrace.plans import fixtures as fx
from learntrace.sources import bucketed
from learntrace.sql.functions import register_functions
from learntrace.sql.tables import register_tables
from tests.conftest import SF


def test_functions_of_the_session(spark):
    names = register_functions(spark)
    assert register_functions(spark) == names and {"softmax", "entropy", "count_forgetting"} <= set(names)
    row = spark.sql("SELECT entropy(array(1D, 0D)) AS e, margin(array(0.5D, 0.25D, 0.25D), 0) AS m, first_argmax(array(1D, 3D, 3D)) AS a, softmax(array(1000D, 1000D)) AS s, vector_norm(array(3D, 4D)) AS v").first()
    assert (row["e"], row["m"], row["a"], row["s"], row["v"]) == (0.0, 0.25, 1, [0.5, 0.5], 5.0)
    plan = spark.sql("SELECT margin(softmax(array(1D, x)), 0) AS m FROM VALUES (1D), (2D) AS t(x)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    events = spark.sql("SELECT count_forgetting(s, a) AS n, first_learned(s, a) AS f, unforgettable(s, a) AS u FROM VALUES (2, false), (0, false), (1, true), (3, true) AS t(s, a)").first()
    assert tuple(events) == (1, 1, False)


def test_table_functions(spark):
    register_tables(spark)
    spark.range(10).selectExpr("id % 2 AS k", "id AS o").createOrReplaceTempView("some_rows")
    got = spark.sql("SELECT * FROM batches(TABLE(some_rows) PARTITION BY k ORDER BY (o DESC), 2)").collect()
    assert sorted((r["k"], r["batch"], r["o"]) for r in got) == sorted((o % 2, (8 + o % 2 - o) // 4, o) for o in range(10))
    for bad in ("batches(TABLE(some_rows), 0)", "batches(1, 2)", "trajectory_events(TABLE(some_rows))"):
        with pytest.raises(Exception, match="batch|table|acc"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_joins_in_buckets_shuffle_nothing(spark):
    rows = fx.logits(spark, SF)
    a = bucketed.write_bucketed(rows.drop("label"), ["example_id"], buckets=4)
    b = bucketed.write_bucketed(rows.select("example_id", "label").distinct(), ["example_id"], buckets=4)
    found = bucketed.joined_in_buckets(spark, a, b, ["example_id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == rows.count()
    by_step = bucketed.write_bucketed(rows.select("step", "example_id"), ["step"], buckets=4)
    with pytest.raises(ValueError, match="buckets"):
        bucketed.joined_in_buckets(spark, a, by_step, ["example_id", "step"])


def jobs_of(spark, work):
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, "counted")
    out = work()
    spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_checks_come_from_the_job_that_writes(spark, tmp_path):
    parts = [spark.range(0, 50), spark.range(50, 80)]
    with pytest.warns(UserWarning, match="80 rows where 100"):
        table, jobs = jobs_of(spark, lambda: observed.write_appended(parts, str(tmp_path / "a"), 100))
    assert jobs == 1 and table.count() == 80
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        observed.write_appended(parts, str(tmp_path / "b"), 80)
    rows = fx.metrics(spark, SF)
    (table, seen), jobs = jobs_of(spark, lambda: observed.write_checked_metrics(rows, str(tmp_path / "c")))
    assert jobs == 1 and seen["n"] == table.count() == rows.count() and seen["unflagged"] == seen["undefined"] == 0
    want = rows.agg(F.min("value"), F.max("value"), F.count_if("is_train")).first()
    assert (seen["least"], seen["most"], seen["n_train"]) == tuple(want)
