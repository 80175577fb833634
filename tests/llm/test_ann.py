"""Nearest vectors against brute force: scores, ranks, ties, odd vectors; balance and graph of the centroids."""

import math

import numpy as np
import pytest

from chronofold.llm import ann


def brute(rows, every=20, k=20):
    good = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = [len(v) for _, v in good]
    dim = min((d for d in set(dims)), key=lambda d: (-dims.count(d), d)) if dims else 0
    good = [(i, np.array(v, float)) for i, v in good if len(v) == dim]
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        best = {}
        for qi, qv in good:
            if qi != q:
                continue
            for i, v in good:
                if i != q:
                    with np.errstate(over="ignore", invalid="ignore"):
                        s = float((qv[None, :] * v[None, :]).sum(1)[0])
                    s = -math.inf if math.isnan(s) else s
                    best[i] = max(best.get(i, -math.inf), s)
        out |= {(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


def vectors(rng, n, dim=8):
    centres = rng.normal(size=(5, dim))
    return [(i, [float(x) for x in centres[i % 5] + 0.3 * rng.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "odd", "huge", "few"])
def test_equals_brute_force(spark, case):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 12 if case == "few" else 400)
    if case == "odd":
        rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [None] + [1.0] * 7), (504, [math.nan] + [1.0] * 7), (505, [math.inf] + [1.0] * 7), (506, [1.0] * 7), (None, rows[0][1]), (40, rows[40][1]), (60, rows[61][1])]
        rows += [(600 + i, rows[20][1]) for i in range(60)] + [(700, [1e-200] * 8)]
    if case == "huge":
        rows += [(800, [1e200] * 8), (801, [-1e200] * 8), (820, [1e180] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, list int, kind string, score double")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df).collect()}
    want = brute(rows)
    if case == "huge":  # next to such vectors all others fall into one list
        assert {x for x in got if x[0] in (800, 820)} == {x for x in want if x[0] in (800, 820)}
    else:
        assert got == want


def test_lists_are_balanced_and_the_graph_finds_the_nearest():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(6000, 16)) * 0.2, rng.normal(size=(600, 16)) + 3])
    g = ann.Centroids(points, 100)
    near = ann._squares(points, g.c).argmin(1)
    assert np.bincount(near, minlength=100).max() <= 4 * 66
    plane = rng.normal(size=(40000, 3)) * 10
    g = ann.Centroids(plane, 1000)
    d = g.search(plane[:500], 1.12, 8)
    assert np.isfinite(d).mean() < 0.5
    assert (d.argmin(1) == ann._squares(plane[:500], g.c).argmin(1)).mean() >= 0.98
    for i in range(1000):
        for j in g.links[g.at[i] : g.at[i + 1]]:
            assert i in g.links[g.at[j] : g.at[j + 1]]
