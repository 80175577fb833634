"""The controller's stream against the batch fold, over a restart from its checkpoint."""

import random

import pytest

from chronofold.operators import states
from chronofold.streaming import controller

SCHEMA, READ = "agent long, seq long, units long", "agent long, seq long, units long, at timestamp"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def run(spark, path, patience=600_000):
    told = controller.controlled(spark.readStream.schema(READ).option("maxFilesPerTrigger", 1).json(str(path / "in")), patience)
    q = told.writeStream.format("parquet").option("checkpointLocation", str(path / "state")).option("path", str(path / "out")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return sorted((r.agent, r.seq, r.ema, r.mode, r.trigger, r.stagnation) for r in spark.read.parquet(str(path / "out")).collect())


def fold(spark, rows):
    got = states.controlled(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.agent, r.seq, r.ema, r.mode, r.trigger, r.stagnation) for r in got)


def test_the_stream_is_the_fold_after_a_restart(rocks, tmp_path):
    rng = random.Random(6)
    (tmp_path / "in").mkdir()
    rows = [(a, k, rng.choice([9, 7, 2, 10]) * 10**9) for a in range(3) for k in range(1, 25)]
    late = rows[:]
    rng.shuffle(late)  # far out of order, over files and over the restart

    def put(name, part):
        (tmp_path / "in" / name).write_text("\n".join('{"agent":%d,"seq":%d,"units":%d,"at":"2024-01-01T00:00:00Z"}' % r for r in part))  # noqa: UP031

    put("0.json", late[:30])
    first = run(rocks, tmp_path)
    put("1.json", late[30:60])
    put("2.json", late[30:40] + late[60:])  # and some again
    told = run(rocks, tmp_path)
    assert set(first) < set(told) and told == fold(rocks, rows)


def test_a_gap_is_given_up_by_the_timer(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"agent":1,"seq":1,"units":9000000000,"at":"2024-01-01T00:00:00Z"}\n{"agent":1,"seq":4,"units":9000000000,"at":"2024-01-01T00:00:00Z"}')
    assert [r[1] for r in run(rocks, tmp_path, 1)] == [1]
    (tmp_path / "in" / "1.json").write_text('{"agent":2,"seq":1,"units":1000000000,"at":"2024-01-01T05:00:00Z"}')
    assert [r[:2] for r in run(rocks, tmp_path, 1)] == [(1, 1), (1, 4), (2, 1)]
