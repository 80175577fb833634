"""A stored chain keeps each hash once on disk, and shuffle files go with the write that made them."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from chronofold.operators import chains
from chronofold.sources.commits import Commits
from chronofold.storage import written


def test_a_hash_takes_its_bytes_once(spark, tmp_path):
    n = 20000
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n + 1)]
    rows = spark.createDataFrame([("s", i, h[i], h[i + 1]) for i in range(n)], "subject string, seq long, prev_hash string, entry_hash string").coalesce(1)
    c = Commits(spark, f"file://{tmp_path}/c")
    assert c.commit({"chain": rows}, 0) == 1
    stored = sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet"))
    assert stored < 42 * n, "32 bytes of a hash, and little else"
    back = c.read("chain")
    assert back.schema == rows.schema and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert chains.heads(back).collect() == [("s", n - 1, h[n])]


def test_tables_of_the_form_before_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "e")], "subject string, prev_hash string, entry_hash string")
    c = Commits(spark, f"file://{tmp_path}/c")
    rows.write.parquet(f"{tmp_path}/old")
    c._published(1, bytearray(b'{"tables": {"chain": {"path": "file://%s/old", "schema": "subject string, prev_hash string, entry_hash string"}}}' % str(tmp_path).encode()))
    c.commit({"chain": spark.createDataFrame([("b", "e", "f")], rows.schema)}, 1)
    assert sorted(map(tuple, c.read("chain").collect())) == [("a", "p", "e"), ("b", "e", "f")]


def test_shuffle_files_go_with_the_write(spark):
    def held():
        return sum(1 for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString().split(",") if "shuffle_" in d)

    before = held()
    t = written(spark.range(20000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count())
    assert t.count() == 1000
    after = held()
    assert after - before <= 4, "those of the count only"
