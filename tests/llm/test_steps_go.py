"""A stage leaves the tables that its result reads, no others, and no shuffle files of what it wrote."""

import os
from fractions import Fraction

import pytest

from chronofold.llm import _util, line_dedup, mixing, ngram_join, toxicity

WORDS = "alder birch cedar damson elm fir gorse hazel iris juniper kale larch maple nettle oak pine quince rowan sorrel thyme".split()


@pytest.fixture()
def docs(spark):
    lines = [" ".join(WORDS[(i * k + k) % 20] for k in range(1, 13)) for i in range(40)]
    rows = [(i, "\n".join([lines[i % 40], lines[(i + 1) % 40] + (" x" if i % 3 else ""), f"own line of {i}"]), f"s{i % 3}") for i in range(120)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string")


def left(spark):
    folder = _util.shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(folder) if x.startswith("table-")}


def test_steps_of_a_stage_are_deleted(spark, docs):
    stages = {
        "lines": lambda: line_dedup.dedup_documents(docs),
        "copies": lambda: ngram_join.one_of_each(docs, n=5, threshold=Fraction(4, 5), tile=4),
        "mix": lambda: mixing.mixed_documents(docs),
    }
    for name, stage in stages.items():
        before = left(spark)
        out = stage()
        assert len(left(spark) - before) <= 5, name
        assert out.count() == len(out.collect()) > 0, name
    before = left(spark)
    toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"))
    assert left(spark) == before


def test_settled_keeps_its_own_table_only(spark):
    before = left(spark)

    def inner():
        return _util.materialize(spark.range(5))

    def outer():
        a = _util.settled(spark, inner)
        assert len(left(spark) - before) == 1 and a.count() == 5
        return a.selectExpr("id + 1 as id")

    out = _util.settled(spark, outer)
    assert len(left(spark) - before) == 1 and {r.id for r in out.collect()} == {1, 2, 3, 4, 5}
    with pytest.raises(RuntimeError, match="stop"):
        with _util.passing(spark):
            inner()
            raise RuntimeError("stop")
    assert len(left(spark) - before) == 1 and not _util._open.tables


def test_shuffle_files_go_with_a_table(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: files.getAllFiles().toString().count("shuffle_")
    before, was = held(), spark.conf.get(_util.CLEARED)
    _util.materialize(spark.range(20000).repartition(7, "id").groupBy("id").count())
    assert held() == before and spark.conf.get(_util.CLEARED) == was
