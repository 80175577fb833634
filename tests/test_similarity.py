"""Nearest vectors of many queries against plain products."""

import random

import pytest

from chronofold.operators import similarity as S


def plain(mem, asked, k, by):
    out = set()
    for qid, q in asked:
        rows = []
        for mid, v, w in mem:
            d, nv, nq = (sum(a * b for a, b in zip(x, y, strict=True)) for x, y in ((v, q), (v, v), (q, q)))
            if nv:
                key = (d * w) * (d * w) / nv if d * w > 0 else 0.0
                rows.append((-(key if by == "cosine" else d if by == "dot" else -(nv + nq - 2 * d)), mid, d, nv))
        out |= {(qid, mid, d, nv) for _, mid, d, nv in sorted(rows)[:k]}
    return out


@pytest.mark.parametrize("by", ["cosine", "dot", "near"])
@pytest.mark.parametrize("most", [2048, 20])
def test_lists_by_all_and_by_blocks(spark, monkeypatch, by, most):
    """Ties, zero vectors, and more memories than a task multiplies at once."""
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = random.Random(5)
    mem = [(i, [rng.randrange(-3, 4) for _ in range(4)], rng.choice([1.0, 1.0, 1.5])) for i in range(300)]
    asked = [(i, [rng.randrange(-3, 4) for _ in range(4)]) for i in range(150)]
    m, q = spark.createDataFrame(mem, "memory_id long, v array<long>, weight double"), spark.createDataFrame(asked, "query_id long, q array<long>")
    got = S.best(m, q, 5, by).select("query_id", "memory_id", "d", "nv").collect()
    assert len(got) == 5 * len(asked) and {tuple(r) for r in got} == plain(mem, asked, 5, by)


def test_whole_numbers_beyond_doubles(spark):
    big = 3_000_000_001
    m = spark.createDataFrame([(1, [big, 1], 1.0), (2, [big, 0], 1.0)], "memory_id long, v array<long>, weight double")
    q = spark.createDataFrame([(0, [1, 1])], "query_id long, q array<long>")
    assert {(r.memory_id, r.d) for r in S.best(m, q, 2, "dot").collect()} == {(1, big + 1), (2, big)}


def test_none(spark):
    m = spark.createDataFrame([], "memory_id long, v array<long>, weight double")
    q = spark.createDataFrame([(0, [1, 1])], "query_id long, q array<long>")
    assert S.best(m, q, 2).count() == 0 and S.best(m, q.limit(0), 2).count() == 0


@pytest.mark.parametrize("by", ["cosine", "dot", "near"])
def test_near_ties_in_single_precision(by):
    """Memories whose products agree in single precision, shown tile by tile: the exact order counts, and tiles are multiplied roughly."""
    import numpy as np

    rng = np.random.default_rng(7)
    base = rng.integers(-(10**6), 10**6, 16)
    v = base + rng.integers(-2, 3, (1500, 16))
    q = base + rng.integers(-3, 4, (40, 16))
    w = np.where(np.arange(1500) % 7, 1.0, 1.0 + 1e-9)
    lists = S.Lists(np.arange(40), q, 6, by)
    for s in range(0, 1500, 700):
        lists.show(v[s : s + 700], np.arange(s, min(1500, s + 700)), w[s : s + 700])
    got = {(r["query_id"], r["memory_id"], r["d"], r["nv"]) for r in lists.told().to_pylist()}
    assert got == plain([(i, v[i].tolist(), float(w[i])) for i in range(1500)], [(i, q[i].tolist()) for i in range(40)], 6, by)
    assert not hasattr(S, "products")


def test_equal_queries_are_asked_once(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST", 8)
    shown = []
    whole = S._by_all
    monkeypatch.setattr(S, "_by_all", lambda m, asked, k, by: shown.append(asked.num_rows) or whole(m, asked, k, by))
    mem = [(i, [i % 5 - 2, i % 7 - 3, 1], 1.0) for i in range(60)]
    asked = [(i, [i % 4 - 1, 2, 1]) for i in range(40)]
    m, q = spark.createDataFrame(mem, "memory_id long, v array<long>, weight double"), spark.createDataFrame(asked, "query_id long, q array<long>")
    got = S.best(m, q, 5, "dot").select("query_id", "memory_id", "d", "nv").collect()
    assert shown == [4] and len(got) == 200 and {tuple(r) for r in got} == plain(mem, asked, 5, "dot")
