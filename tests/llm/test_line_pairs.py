"""A group of alike lines takes pairs in proportion to its size, and components end without a last idle round."""

from chronofold.llm import _util
from chronofold.llm import line_dedup as L


def test_few_pairs_of_alike_lines(spark, monkeypatch):
    line = " ".join(f"word{i:03d}" for i in range(60))
    rows = [(i, f"{line} x{i:02d}") for i in range(60)]
    seen, verified = [], L._verified

    def counted(pairs, *rest):
        seen.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(L, "_verified", counted)
    got = L.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [0]
    assert sum(seen) < 6 * len(rows)


def test_components_write_few_tables(spark, monkeypatch):
    written, materialize = [], _util.materialize
    monkeypatch.setattr(_util, "materialize", lambda df, *by: written.append(1) or materialize(df, *by))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 22), (21, 22), (30, 30)], "a long, b long")
    got = {r.node: r.root for r in _util.components(edges, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 10)} | {20: 20, 21: 20, 22: 20}
    assert len(written) <= 8
    assert not _util.components(edges.where("a = 30"), "a", "b").collect()
    assert sorted(map(tuple, _util.components(edges.where("a = 20"), "a", "b").collect())) == [(20, 20), (22, 20)]
