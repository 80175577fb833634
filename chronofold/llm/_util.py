"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Tables that grow with the corpus are not broadcast, however small they are here.
MERGE = "merge"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which shuffle files go when a write ends.
CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: The tables written in each ``passing`` that runs, by thread.
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one where that is unset and Spark runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="chronofold-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage for good.

    The shuffle files of the write go with it, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if getattr(_open, "tables", None):
        _open.tables[-1].append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEARED)
    spark.conf.set(CLEARED, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEARED, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that are written meanwhile (their paths) are deleted at the end: nothing later may read them."""
    _open.tables = [*getattr(_open, "tables", []), []]
    own = _open.tables[-1]
    try:
        yield own
    finally:
        _open.tables.pop()
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written as a table, without the tables that make wrote on the way."""
    with passing(spark) as own:
        out = materialize(make())
        path = own.pop()
    if _open.tables:
        _open.tables[-1].append(path)
    return out


def sliced(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``limit`` bytes (or list items) of the column, one row at least."""
    values = batch.column(column)
    measure = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(measure(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + limit, "right")), at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A 1-based global rank by ``order`` without sending all rows to one task: range partitions, then offsets."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = dealt.groupBy("_pid").agg(F.count("*").alias("_n"))  # at most one row a partition
    before = sizes.select("_pid", (F.sum("_n").over(W.orderBy("_pid")) - F.col("_n")).alias("_before"))
    local = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_pid").orderBy(*order)))
    return local.join(F.broadcast(before), "_pid").withColumn(name, F.col("_rn") + F.col("_before")).drop("_pid", "_rn", "_before")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows (written and read) numbered from 0 within their keys; a key's rows stay in many tasks.

    Which of a key's rows gets which number depends on the partitions: for rows that are alike.
    """
    dealt = materialize(df.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sums = dealt.groupBy(*keys, "__pid").agg(F.count("*").alias("__n"))
    before = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__pid").alias("__of"), (F.sum("__n").over(W.partitionBy(*keys).orderBy("__pid")) - F.col("__n")).alias("__before"))
    local = dealt.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__pid").orderBy("__at")) - 1)
    same = F.col("__pid") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return local.join(before, same).select(*df.columns, (F.col("__rn") + F.col("__before")).alias(name))


def indexed(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows (written and read) numbered from 0 within their keys by ``order``, which begins with the keys.

    Rows are dealt by ranges of the whole order, so a hot key spreads over many tasks; rows of one order are told
    apart by a seeded random number and spread as well. Numbers come from each task's own count of a key's rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("__tie")]
    dealt = df.withColumn("__tie", F.rand(7)).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__tie")
    dealt = materialize(dealt.withColumn("__id", F.monotonically_increasing_id()))
    pid = F.shiftright("__id", 33)
    runs = dealt.groupBy(*keys, pid.alias("__of")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    so_far = F.sum("__n").over(W.partitionBy(*keys).orderBy("__of")) - F.col("__n")
    runs = runs.select(*[F.col(k).alias(f"__{k}") for k in keys], "__of", (so_far - F.col("__first")).alias("__shift"))
    same = pid == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return dealt.join(runs, same).select(*df.columns, (F.col("__id") + F.col("__shift")).alias(name))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, one group of equal keys at least, that no group straddles; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held)
            last = starts(t, keys)[-1]
            if last:
                yield t.slice(0, last)
            held = t.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Places of the first rows of the runs of equal keys (nulls are equal)."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, own: Column, bits: int = 1 << 25) -> DataFrame:
    """Rows whose key may be among ``keys`` (own): all that are, and by a bitmap of bounded size few others.

    The bitmap (bits / 8 bytes at most, in pieces of 4 KB) is broadcast, so that a join that follows need
    not shuffle rows without a partner.
    """
    return by_bitmap(df, key, keys, own, bits).where("hit").select("row.*")


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of df but those of ``gone`` (doc_id, txh: the hash of the text); only rows that may be among them are shuffled."""
    told = by_bitmap(df, F.xxhash64(F.col("text").cast("string")), gone, F.col("txh"))
    g = gone.select(F.col("doc_id").alias("id"), F.col("txh")).distinct()
    kept = told.where("hit").join(g.hint(MERGE), (F.xxhash64(F.col("row")["text"].cast("string")) == F.col("txh")) & F.col("row")["doc_id"].eqNullSafe(F.col("id")), "left_anti")
    return told.where("not hit").select("row.*").unionByName(kept.select("row.*"))


def by_bitmap(df: DataFrame, key: Column, keys: DataFrame, own: Column, bits: int = 1 << 25) -> DataFrame:
    """row (all columns of df, whatever their names) and hit, whether its key may be among ``keys`` (own)."""
    spot = F.pmod(F.xxhash64(own), F.lit(bits)) + 1
    maps = keys.select(spot.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("map"))
    here = df.select(F.struct(*df.columns).alias("row"), (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).alias("v"))
    here = here.select("row", F.bitmap_bit_position("v").alias("at"), F.bitmap_bucket_number("v").alias("bucket"))
    byte = F.conv(F.hex(F.substring("map", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.lit(1) == F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")).bitwiseAND(F.lit(1)), F.lit(False))
    return here.join(F.broadcast(maps), "bucket", "left").select("row", hit.alias("hit"))


def find(parent: dict, x):
    """Root of x in a union-find forest, with path halving."""
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star steps.

    Returns (node, root), root being the smallest node of the component; nodes without an edge are
    absent. Each step is one aggregation by node, and the edges are written between steps. No
    neighbourhood is collected: a step only needs the smallest neighbour of each node, and no step is broadcast.
    What a step changed is counted while it is written; stars that no step changes are the components.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    )
    if not cur.limit(1).count():
        return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    single = False  # whether every hi is known to have one lo
    for _ in range(rounds):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour hangs on the smallest one
        moved, several = Observation(), Observation()
        large = (
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .join(least.hint(MERGE), "u")
            .observe(moved, F.count_if(F.col("u") != F.col("m")).alias("n"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        large = materialize(large)
        still = not moved.get["n"]  # no lo hangs on another
        if still and single:
            break
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low.hint(MERGE), "hi")
            .observe(several, F.count_if(F.col("lo") != F.col("m")).alias("n"))
            .select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        cur = materialize(small)
        single = not several.get["n"]
        if still and single:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
