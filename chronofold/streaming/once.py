"""Exactly-once batches of a changefeed, and drains in bounded chunks.

A ledger is a folder of numbered batches; each is written whole, under its own number, and counts once its success file is
there. A batch that is delivered again is not handled again, so replays and restarts change nothing. What a batch decides
follows from the tables as they were and from the batches before it, which hold every change so far.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.streaming import changefeed


class Ledger:
    """Rows by batch in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._path = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join((path, *x)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, batch: int) -> bool:
        return self._fs.exists(self._path(f"{batch:012d}", "_SUCCESS"))

    def batches(self) -> list[int]:
        found = self._fs.listStatus(self._path()) if self._fs.exists(self._path()) else []
        return sorted(n for x in found if self.has(n := int(x.getPath().getName())))

    def rows(self) -> DataFrame:
        """The rows of all batches that count, with ``batch``."""
        paths = [f"{self.path}/{n:012d}" for n in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], self.schema + ", batch long")
        return self.spark.read.schema(self.schema + ", batch long").parquet(*paths)

    def add(self, batch: int, make: Callable[[], DataFrame]) -> bool:
        """Write a batch, unless it is there; a batch that broke off is written anew."""
        if self.has(batch):
            return False
        make().withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{batch:012d}")
        return True


ATTEMPT = "memory_id string, origin_region string, outcome string"


def moved(memories: DataFrame, ledger: Ledger) -> DataFrame:
    """The memories where the ledger's migrations have brought them; a memory goes where its last one went."""
    last = ledger.rows().where("outcome = 'MIGRATED'").groupBy("memory_id").agg(F.max_by("origin_region", F.struct("batch", "origin_region")).alias("now"))
    return memories.join(last, "memory_id", "left").withColumn("region_id", F.coalesce("now", "region_id")).drop("now")


def attempted(pairs: DataFrame, regions: DataFrame, memories: DataFrame) -> DataFrame:
    """The pairs with their outcomes; of a memory's migrations of one batch the first by region takes effect, the others come too late."""
    told = changefeed.classified(pairs, regions, memories)
    nth = F.row_number().over(W.partitionBy("memory_id", F.col("outcome") == "MIGRATED").orderBy("origin_region"))
    return told.withColumn("outcome", F.when((F.col("outcome") == "MIGRATED") & (nth > 1), "COOLDOWN").otherwise(F.col("outcome")))


def handler(ledger: Ledger, regions: DataFrame, memories: DataFrame) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over envelopes (value): each pair of a batch is attempted once, each batch handled once."""

    def handle(batch: DataFrame, number: int) -> None:
        def make() -> DataFrame:
            rows = changefeed.parsed(batch.select(F.lit(number).alias("batch"), F.struct("value").alias("v")).select("batch", "v.value"))
            pairs = rows.where("outcome = 'ATTEMPT'").select("memory_id", "origin_region").distinct()
            return attempted(pairs, regions, moved(memories, ledger)).select("memory_id", "origin_region", "outcome")

        ledger.add(number, make)

    return handle


@dataclass(frozen=True)
class Drained:
    """What a drain did: chunks that ran, rows in all, and whether nothing was left."""

    chunks: int
    total: int
    drained: bool


def drain(ledger: Ledger, due: DataFrame, key: str, order: list[str], chunk: int, most: int) -> Drained:
    """Work off the rows of ``due``, the first by ``order`` before others, ``chunk`` at a time and ``most`` chunks.

    A chunk is a batch of the ledger; rows of earlier batches are done. A chunk that is not full ends the drain.
    """
    if chunk < 1 or most < 1:
        raise ValueError("a drain needs a chunk and a number of chunks of 1 at least")
    total = 0
    for i in range(most):
        number = max(ledger.batches(), default=-1) + 1
        left = due.join(ledger.rows().select(key), key, "left_anti")
        ledger.add(number, lambda left=left: left.orderBy(*order, key).limit(chunk).select(*due.columns))
        n = ledger.rows().where(F.col("batch") == number).count()
        total += n
        if n < chunk:
            return Drained(i + 1, total, True)
    return Drained(most, total, False)
