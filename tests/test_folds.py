"""Propagation and folds against plain loops."""

import datetime

from chronofold.operators import replay
from chronofold.streaming import signals


def test_custody_and_excision(spark):
    kinds = ["STORED", "TAINT_FLAGGED", "REINFORCED", "REHABILITATED", "REINFORCED", "REINFORCED"]
    chain = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "subject long, seq long, kind string")
    r = replay.custody_replay(chain).first()
    assert (r.status, r.confidence, r.field_state) == ("CLEAN", 0.7890625, "REINFORCED")
    r = replay.excised_replay(chain, spark.createDataFrame([(1, 4), (1, 3)], "subject long, seq long")).first()
    assert (r.status, r.confidence, r.field_state) == ("TAINT_FLAGGED", 0.71875, "NEUTRAL")


def test_consensus_includes_the_exact_half_and_expiry_the_exact_end(spark):
    at = datetime.datetime(2024, 1, 1, 12, 5)
    rows = [("m1", "purchase", 1.0, at), ("m1", "other", 1.0, at), ("m2", "purchase", 0.4, at), ("m2", "other", 1.0, at), ("m1", "other", 1.0, at + datetime.timedelta(hours=1))]
    signals_ = spark.createDataFrame(rows, "memory_id string, origin string, vigor double, created_at timestamp")
    got = {(r.memory_id, r.live): (r.backing, r.resolved) for r in signals.consensus(signals_).collect()}
    assert got == {("m1", 2): (1.0, True), ("m2", 2): (0.4, False), ("m1", 1): (0.0, False)}
    assert signals.expired(signals_, at + datetime.timedelta(minutes=30)).count() == 4
    assert signals.expired(signals_, at + datetime.timedelta(minutes=29)).count() == 0
    assert signals.consensus(signals_.limit(0)).count() == 0
