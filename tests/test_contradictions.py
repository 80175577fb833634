"""Contradictions as pairs: every pair of a topic, in blocks, and those that no link joins."""

import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronofold.operators import store
from chronofold.plans import catalog


@pytest.fixture()
def field(tmp_path):
    n = 60
    rng = np.random.default_rng(3)
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(rng.random((n, 4)).tolist(), pa.list_(pa.float32())), "label": pa.array([i % 2 for i in range(n)], pa.int32())}), tmp_path / "embeddings.parquet")
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path)
    links = {(v, (7 * v + 1) % n) for v in range(n)} | {(v, (3 * v + 2) % n) for v in range(0, n, 4)}
    pairs = {(a, b) for a in range(n) for b in range(n) if a % 2 == b % 2 and a % 3 != b % 3}
    return str(tmp_path), pairs, links


def test_join_tells_every_pair(spark, field):
    data, pairs, _ = field
    got = [tuple(r) for r in catalog.QUERIES["JOIN-1_contradictions"](spark, data).select("from_id", "to_id").collect()]
    assert len(got) == len(pairs) and set(got) == pairs


def test_new_pairs_are_those_without_a_link(spark, field):
    data, pairs, links = field
    got = [tuple(r) for r in catalog.QUERIES["JOIN-2_new_contradictions"](spark, data).select("from_id", "to_id").collect()]
    want = {(a, b) for a, b in pairs if a < b} - links
    assert len(got) == len(want) and set(got) == want


def test_blocks_lose_and_repeat_nothing(spark):
    a = spark.createDataFrame([(i % 2, i) for i in range(50)], "k int, x long")
    b = spark.createDataFrame([(i % 3, i) for i in range(40)], "k int, y long")
    got = sorted((r.x, r.y) for r in store.in_blocks(a, b, ["k"], "x", "y", 7).collect())
    assert got == sorted((x, y) for x in range(50) for y in range(40) if x % 2 == y % 3)
