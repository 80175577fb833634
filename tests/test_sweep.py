"""As-of and interval joins against pairs of rows."""

import random

import pytest

from chronofold.operators import sweep


@pytest.mark.parametrize("hot", [False, True])
def test_as_of_equals_pairs(spark, hot):
    """Nulls, ties in time, keys of one side only, and a key that holds most rows."""
    rng = random.Random(1)
    key = lambda: 1 if hot and rng.random() < 0.9 else rng.choice([1, 2, 3, None])
    left = [(i, key(), rng.choice([None, *range(40)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(40)]), i, rng.choice(["x", None])) for i in range(200)]
    got = sweep.as_of(spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, seq long, v string"), ["k"], "t", ("seq",)).collect()
    assert len(got) == len(left)
    for r in got:
        own = [x for x in right if x[0] is not None and x[0] == r.k and x[1] is not None and r.t is not None and x[1] <= r.t]
        want = max(own, key=lambda x: (x[1], x[2]), default=None)
        assert (None if r.found is None else tuple(r.found)) == want


def test_covered_equals_pairs(spark):
    rng = random.Random(2)
    events = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b"]), rng.choice([None, *range(30)])) for i in range(300)]
    spans = {n: [(rng.choice([1, 1, 2, None]), rng.choice(["a", "b"]), rng.choice([None, *range(25)]), rng.choice([None, *range(30)])) for _ in range(80)] for n in ("held", "barred")}
    frames = {n: spark.createDataFrame(x, "k long, c string, since long, until long") for n, x in spans.items()}
    got = sweep.covered(spark.createDataFrame(events, "id long, k long, c string, t long"), frames, ["k", "c"], "t").collect()
    assert len(got) == len(events)
    for r in got:
        for n, own in spans.items():
            want = 0 if r.k is None or r.t is None else sum(s[0] == r.k and s[1] == r.c and s[2] is not None and s[2] <= r.t and (s[3] is None or r.t < s[3]) for s in own)
            assert r[n] == want


def test_none(spark):
    left, right = spark.createDataFrame([], "id long, k long, t long"), spark.createDataFrame([], "k long, t long, seq long")
    assert sweep.as_of(left, right, ["k"], "t", ("seq",)).count() == 0
    assert sweep.covered(left, {"n": spark.createDataFrame([], "k long, since long, until long")}, ["k"], "t").count() == 0
