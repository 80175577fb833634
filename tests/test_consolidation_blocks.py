"""Clusters of large groups in blocks, against a loop over single vectors; they are found once in a consolidation."""

import numpy as np
import pytest

from chronofold.operators import consolidation as K


def plain(x, theta):
    """Each vector joins the nearest running centroid within theta, or begins its own."""
    centres, label = [], []
    for v in x:
        cos = [c @ v / np.linalg.norm(c) for c in centres]
        k = int(np.argmax(cos)) if cos else 0
        if cos and cos[k] >= theta:
            centres[k] = centres[k] + v
        else:
            k = len(centres)
            centres.append(v)
        label.append(k)
    return label


@pytest.mark.parametrize("n, dims, groups, noise, theta", [(1500, 8, 40, 0.25, 0.8), (900, 16, 300, 0.1, 0.8), (1200, 3, 5, 0.5, 0.9), (700, 32, 700, 1.0, 0.8), (300, 4, 1, 0.01, 0.5)])
def test_blocks_equal_a_loop(monkeypatch, n, dims, groups, noise, theta):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(groups, dims))[rng.integers(groups, size=n)]
    x = x / np.linalg.norm(x, axis=1)[:, None] + noise * rng.normal(size=(n, dims)) / np.sqrt(dims)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = plain(x, theta)
    for block, centres in ((256, 8192), (7, 5), (1, 1)):
        monkeypatch.setattr(K, "BLOCK", block)
        monkeypatch.setattr(K, "CENTRES", centres)
        assert K.greedy(x, theta).tolist() == want


def test_clusters_are_found_once(spark):
    rows = [(i % 2, i, [float(i % 3 == k) for k in range(3)], 1) for i in range(24)]
    m = spark.createDataFrame(rows, "topic int, memory_id long, v array<double>, recalls long")
    links = spark.createDataFrame([(0, 99), (98, 99)], "from_id long, to_id long")
    memories, kept = K.applied(m.select("memory_id", "v", "recalls"), links, K.clusters(m, "topic", 0.8, 3), 100)
    for df in (memories, kept):
        assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.memory_id for r in memories.collect()) == [100, 101, 102, 103, 104, 105] and kept.count() == 1
