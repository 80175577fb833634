"""The kept index against all rows, after insertions, deletions, a merge, and by version."""

import numpy as np
import pytest

from chronofold.operators.index import Index
from chronofold.sources.commits import Commits

ROW = "memory_id long, v array<long>"


def frame(spark, rows):
    return spark.createDataFrame([(int(i), [int(z) for z in v]) for i, v in rows.items()], ROW)


def nearest(rows, q, k):
    return [i for _, i in sorted((int(((v - q) ** 2).sum()), i) for i, v in rows.items() if v.any())[:k]]


def answers(index, spark, queries, k, **how):
    got = {}
    for r in index.search(spark.createDataFrame([(j, [int(z) for z in q]) for j, q in enumerate(queries)], "query_id long, q array<long>"), k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    return got


def recall(got, rows, queries, k):
    return np.mean([len(set(got.get(j, [])) & set(nearest(rows, q, k))) / min(k, len(rows)) for j, q in enumerate(queries)])


def test_recall_after_a_tenth_of_insertions_and_deletions(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 800
    draw = lambda n: (centres[rng.integers(40, size=n)] + rng.normal(size=(n, 16)) * 200).astype(np.int64)
    rows = dict(enumerate(draw(3000)))
    queries = draw(60)
    index = Index(Commits(spark, f"file://{tmp_path}/index"))
    assert index.build(frame(spark, rows)) == 1
    assert recall(answers(index, spark, queries, 10), rows, queries, 10) >= 0.9
    new = {3000 + i: v for i, v in enumerate(draw(300))} | {i: v for i, v in zip(range(0, 100), draw(100), strict=True)}  # 100 ids are replaced
    index.insert(frame(spark, new))
    rows |= new
    dead = [int(i) for i in rng.choice(list(rows), 300, replace=False)]
    last = index.delete(spark.createDataFrame([(i,) for i in dead], "memory_id long"))
    rows = {i: v for i, v in rows.items() if i not in set(dead)}
    got = answers(index, spark, queries, 10)
    assert not {i for x in got.values() for i in x} & set(dead) and recall(got, rows, queries, 10) >= 0.9
    exact = answers(index, spark, queries, 10, exact=True)
    assert exact == {j: nearest(rows, q, 10) for j, q in enumerate(queries)}
    index.insert(frame(spark, {dead[0]: queries[0]}))  # a deleted id comes back
    rows[dead[0]] = queries[0]
    assert answers(index, spark, queries[:1], 3)[0][0] == dead[0]
    index.merge()
    assert index.rows().where("first").count() == len(rows) and recall(answers(index, spark, queries, 10), rows, queries, 10) >= 0.9
    assert index.rows(last).where("first").count() == len(rows) - 1, "an earlier version stays readable"


def test_few_rows_copies_and_an_exact_answer(spark, tmp_path):
    index = Index(Commits(spark, f"file://{tmp_path}/index"))
    with pytest.raises(ValueError, match="not built"):
        index.rows()
    rows = {i: np.array([5, 5]) for i in range(30)} | {30 + i: np.array([1000 * i, 7]) for i in range(6)}
    index.build(frame(spark, rows), lists=6)
    got = answers(index, spark, [np.array([5, 6]), np.array([4000, 7])], 33, probes=1)
    assert got == {j: nearest(rows, q, 33) for j, q in enumerate([np.array([5, 6]), np.array([4000, 7])])}


def test_empty(spark, tmp_path):
    index = Index(Commits(spark, f"file://{tmp_path}/index"))
    index.build(frame(spark, {}))
    assert answers(index, spark, [np.array([1, 2])], 3) == {}
