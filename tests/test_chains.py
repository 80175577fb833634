"""Chains, audit logs, seals and canonical values against the standard library."""

import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.operators import audit, chains

PENDING = "subject string, place long, event_type string, actor string, reason string, created_at string, payload_json string"


def stamp(i):
    return f"2024-01-01T00:00:{i:02d}.000000+00:00"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def events(n=6):
    return [("m-1", i, "STORED" if i == 0 else "REINFORCED", "a:1", 'say "é"\n\x01', stamp(i), C.dumps({"b": i, "a": "ü"})) for i in range(n)]


def test_append_equals_the_standard_library(spark):
    rows = chains.append(chains.CUSTODY, spark.createDataFrame(events(), PENDING)).orderBy("seq").collect()
    prev = sha("CUSTODY_GENESIS:m-1")
    for r, e in zip(rows, events(), strict=True):
        body = {"memory_id": "m-1", "seq": r.seq, "event_type": e[2], "actor_id": e[3], "reason": e[4], "created_at": e[5], "payload": json.loads(e[6])}
        assert r.prev_hash == prev
        prev = sha(prev + json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        assert r.entry_hash == prev


def test_append_after_a_head_and_refusals(spark):
    first = chains.append(chains.CUSTODY, spark.createDataFrame(events(3), PENDING))
    more = [("m-1", 0, "REINFORCED", "a", "r", stamp(9), "{}"), ("m-1", 1, "STORED", "a", "r", stamp(9), "{}"), ("m-1", 2, "OTHER", "a", "r", stamp(9), "{}"), ("m-1", 3, "REINFORCED", "a", " ", stamp(9), "{}"), ("m 2", 4, "STORED", "a", "r", stamp(9), "{}"), ("m-3", 5, "REINFORCED", "a", "r", stamp(9), "{}"), ("m-3", 6, "STORED", "a", "r", stamp(9), "{}"), ("m-3", 7, "QUARANTINED", "a", "r", stamp(9), "{}")]
    pending = spark.createDataFrame(more, PENDING)
    codes = {r.place: r.code for r in chains.judged(chains.CUSTODY, pending, first).collect()}
    assert codes == {0: None, 1: "SECOND_BIRTH", 2: "UNKNOWN_EVENT", 3: "NO_REASON", 4: "BAD_ID", 5: "NOT_BORN", 6: None, 7: None}
    added = chains.append(chains.CUSTODY, pending, first)
    assert {(r.subject, r.seq) for r in added.collect()} == {("m-1", 3), ("m-3", 0), ("m-3", 1)}
    assert {r.code for r in chains.verify(chains.CUSTODY, first.unionByName(added)).collect()} == {None}


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda r: {**r, "created_at": "2023-01-01T00:00:00.000000+00:00"} if r["seq"] == 3 else r, "TAMPERED"), (lambda r: {**r, "payload_json": '{"a": 1}'} if r["seq"] == 1 else r, "NOT_CANONICAL"),
        (lambda r: {**r, "entry_hash": "0" * 64} if r["seq"] == 5 else r, "TAMPERED"), (lambda r: {**r, "subject": "m-2"}, "NOT_LINKED"), (lambda r: {**r, "seq": r["seq"] + 1}, "SEQ_NOT_DENSE"),
        (lambda r: {**r, "payload_json": None} if r["seq"] == 2 else r, "NOT_JSON"), (lambda r: {**r, "event_type": None} if r["seq"] == 2 else r, "UNKNOWN_EVENT"),
    ],
)
def test_a_changed_row_is_found(spark, change, code):
    rows = chains.append(chains.CUSTODY, spark.createDataFrame(events(), PENDING))
    damaged = spark.createDataFrame([tuple(change(r.asDict())[c] for c in rows.columns) for r in rows.collect()], rows.schema)
    assert chains.verify(chains.CUSTODY, damaged).first().code == code


def test_time_may_not_run_backwards_and_stamps_are_canonical(spark):
    e = [(*x[:5], t, x[6]) for x, t in zip(events(3), [stamp(5), stamp(4), stamp(6)], strict=True)]
    assert chains.verify(chains.CUSTODY, chains.append(chains.CUSTODY, spark.createDataFrame(e, PENDING))).first().code == "BACKWARDS"
    e = [(*x[:5], "2024-01-01T00:00:00+05:00", x[6]) for x in events(1)]
    assert chains.verify(chains.CUSTODY, chains.append(chains.CUSTODY, spark.createDataFrame(e, PENDING))).first().code == "BAD_TIMESTAMP"


def plain_root(level):
    while len(level) > 1:
        level = [sha(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 13])
def test_merkle_root_equals_pair_by_pair(spark, monkeypatch, n):
    monkeypatch.setattr(chains, "BLOCK", 4)
    leaves = [sha(str(i)) for i in range(n)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(leaves)], "i long, leaf string").repartition(3)
    assert chains.merkle_root(df, [F.col("i")]).first().root == plain_root(leaves)
    assert chains.merkle_root(df.limit(0), [F.col("i")]).first().root == sha("EMPTY_HEADS")
    with pytest.raises(ValueError, match="no leaves"):
        chains.merkle_root(df.limit(0), [F.col("i")], None)


def test_seals_and_canonical_values(spark):
    ids = ["b", "a", 'q"', "é", "a"]
    got = chains.seals(spark.createDataFrame([(1, x) for x in ids], "g long, memory_id string"), "g", "memory_id").first()
    assert got.n == 4 and got.ids_sha256 == sha(json.dumps({"memory_ids": sorted(set(ids))}, separators=(",", ":"), ensure_ascii=False))
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([*range(40), 92, 127, 233, 0x1F600])) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in df.select(C.json_string(F.col("t")).alias("j")).collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]
    amounts = [Decimal("0.00000000005"), Decimal("0.00000000015"), Decimal("2E-10"), Decimal("-1.5"), Decimal("1234567.00000000025")]
    df = spark.createDataFrame([(a,) for a in amounts], "a decimal(38,18)")
    assert [r.f for r in df.select(C.fixed(F.col("a")).alias("f")).collect()] == [format(C.quantize(a), "f") for a in amounts]


def test_strict_canonical_json():
    assert C.dumps({"b": Decimal("0.5000000000"), "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":"0.5000000000"}'
    for bad in (0.5, Decimal("0.5")):
        with pytest.raises((TypeError, ValueError)):
            C.dumps({"x": bad})
    for text, fault in (('{"a":1,"a":1}', "NOT_JSON"), ('{"a":Infinity}', "NOT_JSON"), ("", "NOT_JSON"), ("[1]", "NOT_CANONICAL"), ('{"a":1.5}', "NOT_CANONICAL"), ('{"a":1}', None)):
        assert C.payload_fault(text) == fault


def test_audit_issues_of_every_row(spark):
    rows = audit.append(spark.createDataFrame([(1, i, f"p{i}") for i in range(5)] + [(2, 0, "x")], "log long, seq long, payload string"))
    assert not audit.issues(rows).count()
    damaged = rows.withColumn("payload", F.when(F.col("seq").isin(1, 3), "other").otherwise(F.col("payload")))
    assert sorted((r.log, r.seq, r.linked, r.sound) for r in audit.issues(damaged).collect()) == [(1, 1, True, False), (1, 3, True, False)]
