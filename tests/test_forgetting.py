"""Hand-made trajectories, and every binary string against a plain simulation."""

import itertools
import random

import pytest

from learntrace.operators.forgetting import forget_metrics
from learntrace.operators.segments import merged, of_step, scores, segments_of

GOLDEN = {  # firstlearn, firstunforgettable, firstforget, firstunlearnable, countforget, unforgettable
    "1111111": (0, 0, 7, 7, 0, True), "0000000": (7, 7, 0, 0, 0, False), "0111111": (1, 1, 0, 7, 0, True),
    "1000000": (0, 7, 1, 1, 1, False), "1010101": (0, 6, 1, 7, 3, False), "0101010": (1, 7, 0, 6, 3, False),
}


def frame(spark, strings):
    return spark.createDataFrame([(s, i, c == "1") for s in strings for i, c in enumerate(s)], "k string, step int, acc boolean")


def both(spark, strings):
    df = frame(spark, strings)
    zero = {r["k"]: r for r in forget_metrics(df, ["k"], True).collect()}
    one = {r["k"]: r for r in forget_metrics(df, ["k"], False).collect()}
    return zero, one


def test_golden(spark):
    zero, one = both(spark, GOLDEN)
    for s, want in GOLDEN.items():
        z, o = zero[s], one[s]
        assert (z["firstlearn"], z["firstunforgettable"], o["firstforget"], o["firstunlearnable"], z["countforget"], z["unforgettable"]) == want


def simulate(bits, start):
    prev, forgets = start, 0
    for b in bits:
        forgets += prev and not b
        prev = b
    return forgets, forgets == 0 and any(bits)


def test_every_short_string(spark):
    strings = ["".join(x) for n in range(1, 7) for x in itertools.product("01", repeat=n)]
    zero, one = both(spark, strings)
    for s in strings:
        bits = [c == "1" for c in s]
        assert (zero[s]["countforget"], zero[s]["unforgettable"]) == simulate(bits, False)
        assert (one[s]["countforget"], one[s]["unforgettable"]) == simulate(bits, True)


@pytest.mark.parametrize("parts", range(1, 5))
def test_segments_merge_in_any_order_and_parts(parts):
    draw = random.Random(parts)
    for s in ["".join(x) for n in range(1, 7) for x in itertools.product("01", repeat=n)]:
        steps = [(i, c == "1") for i, c in enumerate(s)]
        draw.shuffle(steps)
        state = []
        for at in range(parts):
            again = [of_step(*x) for x in draw.sample(steps[: at * len(steps) // parts], min(2, at * len(steps) // parts))]
            state = merged([*state, *(of_step(*x) for x in steps[at * len(steps) // parts : (at + 1) * len(steps) // parts]), *again])
        assert len(state) == 1
        for start in (True, False):
            n, forgets, unforgettable, first, last = scores(state, start)
            assert (n, forgets, unforgettable) == (len(s), *simulate([c == "1" for c in s], not start))
            assert first == (s.index("1") if "1" in s else len(s)) and last == (s.rindex("0") + 1 if "0" in s else 0)


def test_segments_with_gaps_and_strides():
    assert len(merged([of_step(i, True) for i in (0, 10, 20, 40)], 10)) == 2
    assert scores(merged([of_step(0, True), of_step(5, False)]))[:2] == (2, 1)  # neighbours until the gap is filled
    assert scores(merged([of_step(i, i < 3) for i in (5, 0, 2, 1, 4, 3)]))[:2] == (6, 1)
    two = merged([of_step(1, True), of_step(2, False)])
    with pytest.raises(ValueError):
        merged([*two, *merged([of_step(2, True), of_step(3, True)])])


def test_summaries_of_tables_are_those_of_rows(spark):
    rows = [(1, i, i % 3 == 0) for i in (0, 1, 2, 5, 6, 9)] + [(2, 4, False), (2, 4, True)]
    got = segments_of(spark.createDataFrame(rows, "example_id long, step int, acc boolean")).orderBy("example_id", "first").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(s) for s in [*merged([of_step(i, a) for e, i, a in rows if e == 1]), of_step(4, False)]]
