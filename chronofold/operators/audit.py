"""Audit logs and snapshot ledgers: hashes that follow the payload, and roots that chain."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import canonical as C

GENESIS = "0" * 64


def append(rows: DataFrame) -> DataFrame:
    """Adds prev_hash and audit_hash to rows (log, seq, payload): the hash of the payload followed by the previous hash."""
    schema = rows.schema.add("prev_hash", "string").add("audit_hash", "string")

    def run(batches):
        log, last = None, GENESIS
        for b in batches:
            prev, own = [], []
            for g, p in zip(b.column("log").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if g != log:
                    log, last = g, GENESIS
                prev.append(last)
                last = hashlib.sha256((p + last).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], names=schema.names)

    return rows.repartition("log").sortWithinPartitions("log", "seq").mapInArrow(run, schema)


def issues(rows: DataFrame) -> DataFrame:
    """log, seq, linked, sound of the rows with an issue: every row is judged, whatever went before it."""
    before = F.lag("audit_hash", 1, GENESIS).over(W.partitionBy("log").orderBy("seq"))
    told = rows.withColumn("linked", F.col("prev_hash") == before).withColumn("sound", C.sha256(F.concat("payload", "prev_hash")) == F.col("audit_hash"))
    return told.where("not linked or not sound").select("log", "seq", "linked", "sound")


def tail_issues(rows: DataFrame, n: int) -> DataFrame:
    """Links that do not hold among the last n rows of each log."""
    w = W.partitionBy("log").orderBy("seq")
    last = rows.withColumn("r", F.row_number().over(W.partitionBy("log").orderBy(F.desc("seq")))).withColumn("before", F.lag("audit_hash").over(w))
    return last.where((F.col("r") < n) & F.col("before").isNotNull() & (F.col("before") != F.col("prev_hash"))).select("log", "seq")
