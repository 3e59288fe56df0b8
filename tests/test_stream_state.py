"""Segments of many examples at once, and the buckets that a stream holds them in."""

import numpy as np
import pytest

from learntrace.operators import segments
from learntrace.streaming import online

STEPS = "example_id long, step long, acc boolean"


def plain_segments(right):
    """Segments of {step: acc} by a loop over the steps."""
    out = []
    for s in sorted(right):
        acc = right[s]
        if out and out[-1][1] == s - 1:
            a = out[-1]
            a[4] += a[3] and not acc
            a[1], a[3] = s, acc
        else:
            a = [s, s, acc, acc, 0, None, None]
            out.append(a)
        a[5], a[6] = (s if a[5] is None else a[5], a[6]) if acc else (a[5], s)
    return [tuple(a) for a in out]


def plain_scores(right, start_at_zero):
    steps, before, forgot = sorted(right), not start_at_zero, 0
    for s in steps:
        forgot, before = forgot + (before and not right[s]), right[s]
    learnt, wrong = [s for s in steps if right[s]], [s for s in steps if not right[s]]
    return len(steps), forgot, forgot == 0 and bool(learnt), learnt[0] if learnt else len(steps), wrong[-1] + 1 if wrong else 0


def test_merging_many_examples_equals_loops():
    rng = np.random.default_rng(5)
    for _ in range(60):
        keys, length = rng.integers(1, 9), rng.integers(1, 30)
        truth = {(int(k), s): bool(rng.random() < 0.5) for k in range(keys) for s in range(length) if rng.random() < 0.8}
        held, seen = segments.table([[] for _ in segments.FIELDS]), {}
        for _ in range(4):
            part = [x for x in truth if rng.random() < 0.4] * 2  # each step twice, and those of earlier parts again
            rng.shuffle(part)
            if not part:
                continue
            ids, step = (np.array([x[i] for x in part]) for i in (0, 1))
            held = segments.merged(held, segments.of_steps(ids, step, np.array([truth[tuple(map(int, x))] for x in part])))
            for k, s in part:
                seen.setdefault(int(k), {})[int(s)] = truth[int(k), int(s)]
            assert list(zip(*segments.lists(held), strict=True)) == [(k, *x) for k in sorted(seen) for x in plain_segments(seen[k])]
            for zero in (True, False):
                got = segments.scores(held, zero)
                assert list(zip(*(x.tolist() for x in got.values()), strict=True)) == [(k, *plain_scores(seen[k], zero)) for k in sorted(seen)]


def test_summaries_that_overlap_are_named():
    one = segments.table([[1], [0], [5], [True], [True], [0], [0], [None]])
    with pytest.raises(ValueError, match="steps 3 to 5 are in two"):
        segments.merged(one, segments.table([[1], [3], [9], [True], [True], [0], [3], [None]]))
    apart = segments.merged(one, segments.of_steps(np.array([2, 1]), np.array([6, 2]), np.array([False, False])))
    assert list(zip(*segments.lists(apart), strict=True)) == [(1, 0, 5, True, True, 0, 0, None), (2, 6, 6, False, False, 0, None, 6)]


def test_state_holds_buckets_and_not_keys(spark, tmp_path):
    """A state call a bucket: the store has no more states than buckets, however many examples."""
    folder = str(tmp_path / "steps")
    keys = 3 * online.BUCKETS
    rows = spark.range(2 * keys).selectExpr("id % {0} AS example_id".format(keys), "2 * (id div {0}) AS step".format(keys), "id % 3 = 0 AS acc")
    got = online.drain_parts(spark, folder, [rows], STEPS, online.forget_scores)
    assert got.count() == keys
    out = online.results_folder(folder)
    with online.state_store(spark):
        states = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "segments").load().count()
    assert states <= online.BUCKETS
    held = online.read_state(spark, out)
    assert sorted(map(tuple, held.select("example_id", "first", "first_acc").collect())) == sorted(map(tuple, rows.collect()))


def test_nulls_and_ids_beyond_doubles(spark, tmp_path):
    """A null example is one of its own, a null acc is wrong, large ids stay exact, also in what a stream starts from."""
    big = 2**53 + 1
    early = spark.createDataFrame([(None, 0, True), (0, 0, False), (big, 0, True), (big - 1, 0, False)], STEPS)
    late = spark.createDataFrame([(None, 1, None), (0, 1, True), (big, 2, True)], STEPS)
    folder = str(tmp_path / "steps")
    got = online.drain_parts(spark, folder, [late], STEPS, lambda s: online.forget_scores(s, saved=segments.segments_of(early)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 2, 1, False, 0, 2), (0, 2, 0, True, 1, 1), (big, 2, 0, True, 0, 0)], key=str)
    held = online.read_state(spark, online.results_folder(folder))
    want = [(None, 0, 1), (0, 0, 1), (big, 0, 0), (big, 2, 2), (big - 1, 0, 0)]
    assert sorted(map(tuple, held.select("example_id", "first", "last").collect()), key=str) == sorted(want, key=str)
