"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Rows that a task sorts or hashes at once, however large the table is.
ROWS_A_TASK = 1 << 20
#: Spark's setting for it.
CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and Spark runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="chronofold-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written meanwhile go when it is written, not when the driver collects its garbage."""
    before = spark.conf.get(CLEARED)
    spark.conf.set(CLEARED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEARED, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table, written and read again: its lineage ends there and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    with cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as keep ``ROWS_A_TASK`` of its rows, or of a table joined with it, in each."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // ROWS_A_TASK)), *keys)


def positioned(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in a global order, from 0: range partitions and offsets, no single task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    pid = F.shiftright("__id", 33)
    sizes = dealt.groupBy(pid.alias("__pid")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))  # a row a partition
    shift = sizes.select("__pid", (F.sum("__n").over(W.orderBy("__pid")) - F.col("__n") - F.col("__first")).alias("__shift"))
    return dealt.join(F.broadcast(shift), pid == F.col("__pid")).select(*df.columns, (F.col("__id") + F.col("__shift")).cast("long").alias(name))
