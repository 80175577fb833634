"""Tables that grow with the corpus are not broadcast, so the driver's memory does not grow with them."""

import random
import re

from chronofold.llm import _util, ngram_join


def planned(monkeypatch, module, plans):
    whole = module.materialize

    def seen(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, *by)

    monkeypatch.setattr(module, "materialize", seen)


def broadcast(plans):
    """Keys of broadcast joins; that of the bitmaps, which are of bounded size, is bucket."""
    return {k for p in plans for k in re.findall(r"BroadcastHashJoin \[([a-z_]+)", p)} - {"bucket"}


def test_components(spark, monkeypatch):
    plans = []
    planned(monkeypatch, _util, plans)
    got = _util.components(spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9], "a long, b long"), "a", "b")
    assert {(r.node, r.root) for r in got.collect()} == {(i, i - i % 10) for i in range(40)}
    assert not broadcast([*plans, got._jdf.queryExecution().executedPlan().toString()])


def test_jaccard_join(spark, monkeypatch):
    plans = []
    for module in (_util, ngram_join):
        planned(monkeypatch, module, plans)
    rng = random.Random(2)
    words = [str(i) for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)]
    rows += [(100 + i, rows[i % 20][1] + f" x{i}") for i in range(60)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), tile=2)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert not broadcast(plans)
