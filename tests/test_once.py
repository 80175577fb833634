"""Batches handled once, whatever is delivered again; drains that drain."""

import random

import pytest

from chronofold.streaming import once

REGIONS = [("r0", True, False), ("r1", True, False), ("r2", True, True), ("r3", False, False)]
MEMORIES = [("m1", "r0", "REGIONAL", 3, 4), ("m2", "r0", "REGIONAL", 1, 4), ("m3", "r1", "ORPHANED", 4, 4), ("m4", "r0", "REGIONAL", 4, 4)]


def image(m, r, s="PENDING"):
    return '{"after":{"memory_id":"%s","origin_region":"%s","status":"%s"}}' % (m, r, s)  # noqa: UP031


def envelope(*images):
    return f'{{"payload":[{",".join(images)}],"length":{len(images)}}}'


DELIVERIES = [
    [envelope(image("m1", "r1"), image("m1", "r1"), image("m2", "r1"), image("m9", "r1"), image("m4", "r1", "ACCEPTED"))], [envelope(image("m1", "r1"), image("m3", "r0"), image("m4", "r2"), image("m4", "r3")), '{"resolved":"1"}'],
    [envelope(image("m1", "r0"), image("m4", "r0"), image("m4", "r1"))],
]


def plain():
    """Outcomes by batch, one attempt after the other."""
    where, out = {m[0]: m[1] for m in MEMORIES}, []
    told, regions = {m[0]: m for m in MEMORIES}, {r[0]: r for r in REGIONS}
    for n, pairs in enumerate([[("m1", "r1"), ("m2", "r1"), ("m9", "r1")], [("m1", "r1"), ("m3", "r0"), ("m4", "r2"), ("m4", "r3")], [("m1", "r0"), ("m4", "r0"), ("m4", "r1")]]):
        for m, r in pairs:
            if m not in told:
                outcome = "LOOKUP_ERROR"
            elif not regions[r][1]:
                outcome = "REGION_UNAVAILABLE"
            elif told[m][2] == "ORPHANED":
                outcome = "ORPHANED"
            elif where[m] == r:
                outcome = "ALREADY_THERE"
            elif regions[r][2]:
                outcome = "COOLDOWN"
            else:
                outcome = "MIGRATED" if 2 * told[m][3] >= told[m][4] else "NOT_REACHED"
            if outcome == "MIGRATED":
                where[m] = r
            out.append((n, m, r, outcome))
    return sorted(out), where


@pytest.fixture()
def world(spark, tmp_path):
    ledger = once.Ledger(spark, f"file://{tmp_path}/ledger", once.ATTEMPT)
    regions = spark.createDataFrame(REGIONS, "region_id string, active boolean, cooling boolean")
    memories = spark.createDataFrame(MEMORIES, "memory_id string, region_id string, tier string, backing int, live int")
    return ledger, regions, memories


def rows(ledger):
    return sorted((r.batch, r.memory_id, r.origin_region, r.outcome) for r in ledger.rows().collect())


def test_a_stream_of_batches_and_its_replay(spark, tmp_path, world):
    ledger, regions, memories = world
    (tmp_path / "in").mkdir()

    def run(state):
        stream = spark.readStream.option("maxFilesPerTrigger", 1).option("wholetext", "false").text(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(once.handler(ledger, regions, memories)).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    for i, d in enumerate(DELIVERIES):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(d))
        run("state")
    want, where = plain()
    assert rows(ledger) == want
    assert {r.memory_id: r.region_id for r in once.moved(memories, ledger).collect()} == where
    run("another")  # a lost checkpoint: all batches are delivered again
    assert rows(ledger) == want


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path, world):
    ledger, regions, memories = world
    handle = once.handler(ledger, regions, memories)
    part = tmp_path / "ledger" / "000000000000"
    part.mkdir(parents=True)
    (part / "part-0.parquet").write_bytes(b"half")
    assert ledger.batches() == [] and ledger.rows().count() == 0
    handle(spark.createDataFrame([(DELIVERIES[0][0],)], "value string"), 0)
    assert rows(ledger) == [x for x in plain()[0] if x[0] == 0]


@pytest.mark.parametrize("n, chunk, most", [(25, 10, 5), (20, 10, 5), (50, 10, 3), (0, 10, 3)])
def test_a_drain_drains(spark, tmp_path, n, chunk, most):
    rng = random.Random(n)
    due = [(i, rng.randrange(8)) for i in range(n)]
    ledger = once.Ledger(spark, f"file://{tmp_path}/drain", "id long, at long")
    df = spark.createDataFrame(due, "id long, at long")
    got = once.drain(ledger, df, "id", ["at"], chunk, most)
    first = sorted(due, key=lambda x: (x[1], x[0]))[: chunk * most]
    assert got == once.Drained(min(most, n // chunk + 1), len(first), n < chunk * most)
    assert sorted((r.batch, r.id) for r in ledger.rows().collect()) == sorted((k // chunk, x[0]) for k, x in enumerate(first))
    if n > chunk * most:
        assert once.drain(ledger, df, "id", ["at"], chunk, 9) == once.Drained((n - chunk * most) // chunk + 1, n - chunk * most, True)
