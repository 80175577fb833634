"""Walks from both ends: the least steps, and how little of the graph is visited."""

import random

from chronofold.operators import activation as A


def least(seed, to, edges, most=10):
    front, seen = {seed}, {seed}
    for n in range(1, most + 1):
        front = {b for a, b in edges if a in front} - seen
        if to in front:
            return n
        seen |= front
    return None


def tables(spark, pairs, edges):
    near = spark.createDataFrame([e for i, e in enumerate(edges) if i % 3], "a long, b long")
    links = spark.createDataFrame([(*e, "RESONANT") for i, e in enumerate(edges) if not i % 3] + [(1, 2, "INHIBITORY")], "from_id long, to_id long, link_type string")
    return spark.createDataFrame(pairs, "query_id long, seed long, memory_id long"), near, links


def test_steps_are_the_least(spark):
    rng = random.Random(11)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)} | {(100 + i, 101 + i) for i in range(13)})
    pairs = [(i, rng.randrange(40), rng.randrange(40, 80) % 40) for i in range(25)] + [(50 + n, 100, 100 + n) for n in range(1, 13)]
    pairs = [p for p in pairs if p[1] != p[2]]
    got = {(r.query_id, r.memory_id): r.steps for r in A._walked(*tables(spark, pairs, edges)).collect()}
    assert got == {(q, m): n for q, s, m in pairs if (n := least(s, m, edges))}


def test_a_walk_does_not_visit_the_graph(spark, monkeypatch):
    """A tree of 1023 nodes with its leaves far from the root: half of the way is walked from the leaf."""
    edges = [(i, c) for i in range(1, 512) for c in (2 * i, 2 * i + 1)]
    most = [0]
    whole = A.written

    def seen(df):
        out = whole(df)
        most[0] = max(most[0], out.count() if "a" not in out.columns else 0)
        return out

    monkeypatch.setattr(A, "written", seen)
    got = A._walked(*tables(spark, [(0, 1, 700)], edges)).collect()
    assert [(r.memory_id, r.steps) for r in got] == [(700, 9)] and most[0] <= 64
