"""Seeded vectors are made some at a time, whatever the batch."""

import pyarrow as pa

from chronofold.operators import agent


def test_runs_of_bounded_size():
    caught = []

    class Texts:
        schema = {"id": type("F", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            caught.append(run)

    agent.seeded(Texts(), 8)
    n = 3 * agent.EMBEDDED + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"text {i % 700}" for i in range(n)])], names=["id", "text"])
    out = list(caught[0](iter([batch])))
    assert [b.num_rows for b in out] == [agent.EMBEDDED] * 3 + [5]
    assert pa.Table.from_batches(out).column("id").to_pylist() == list(range(n))
    v = [x for b in out for x in b.column("v").to_pylist()]
    assert v[0] == v[700] and v[0] != v[1] and all(abs(sum(y * y for y in x) - 1) < 1e-12 for x in v)
