"""Changefeeds: parsing batches of row images, handling them once, and the periodic sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENVELOPE = "payload array<struct<after:struct<memory_id:string,origin_region:string,status:string>,key:array<string>,updated:string,resolved:string>>, length int, resolved string"


def parsed(batches: DataFrame) -> DataFrame:
    """batch, place, memory_id, origin_region, outcome of each row image of JSON batches (batch, value).

    ATTEMPT for a pending signal, once a pair and batch (the first); IGNORED for heartbeats, deletions, other statuses and
    repeats; MALFORMED for images without memory or origin, and for batches that are no envelope.
    """
    df = batches.withColumn("e", F.from_json("value", ENVELOPE))
    rows = df.select("batch", F.col("e.resolved").alias("heartbeat"), F.posexplode_outer("e.payload").alias("place", "p"))
    a = F.col("p.after")
    bad = F.col("p").isNull() & F.col("heartbeat").isNull() | F.col("p").isNotNull() & a.isNotNull() & (a["memory_id"].isNull() | a["origin_region"].isNull() | a["status"].isNull())
    outcome = F.when(bad, "MALFORMED").when(a.isNull() | (a["status"] != "PENDING"), "IGNORED").otherwise("ATTEMPT")
    told = rows.select("batch", "place", a["memory_id"].alias("memory_id"), a["origin_region"].alias("origin_region"), outcome.alias("outcome"))
    first = F.row_number().over(W.partitionBy("batch", "memory_id", "origin_region", "outcome").orderBy("place")) > 1
    return told.withColumn("outcome", F.when((F.col("outcome") == "ATTEMPT") & first, "IGNORED").otherwise(F.col("outcome")))


def attempts(values: DataFrame) -> DataFrame:
    """memory_id, origin_region of a stream (or table) of envelopes (value, at): one a pair, however often it is delivered.

    On a stream the pairs seen within the watermark are the state.
    """
    p = values.select("at", F.explode(F.from_json("value", ENVELOPE)["payload"]["after"]).alias("a"))
    pending = p.where("a.status = 'PENDING' and a.memory_id is not null and a.origin_region is not null").select("at", "a.memory_id", "a.origin_region")
    if values.isStreaming:
        return pending.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["memory_id", "origin_region"]).select("memory_id", "origin_region")
    return pending.select("memory_id", "origin_region").distinct()


def classified(pairs: DataFrame, regions: DataFrame, memories: DataFrame) -> DataFrame:
    """The pairs (memory_id, origin_region) with what an attempt to move comes to.

    regions: region_id, active, cooling; memories: memory_id, region_id, tier, backing, live (votes for the origin and in all).
    """
    df = pairs.join(memories, "memory_id", "left").join(regions, F.col("origin_region") == regions["region_id"], "left").drop(regions["region_id"])
    outcome = (
        F.when(F.col("tier").isNull(), "LOOKUP_ERROR").when(~F.coalesce("active", F.lit(False)), "REGION_UNAVAILABLE").when(F.col("tier") == "ORPHANED", "ORPHANED")
        .when(F.col("region_id") == F.col("origin_region"), "ALREADY_THERE").when(F.col("cooling"), "COOLDOWN")
        .when(2 * F.col("backing") >= F.col("live"), "MIGRATED").otherwise("NOT_REACHED")
    )
    return df.select("memory_id", "origin_region", outcome.alias("outcome"))


def orphaned(memories: DataFrame, now, days: int = 7, most: int = 1000) -> DataFrame:
    """The stalest memories (memory_id, tier, state, created_at, last_*) without a sign of life for the window."""
    last = F.greatest(*[F.coalesce(c, "created_at") for c in memories.columns if c.startswith("last_")], F.col("created_at"))
    stale = memories.withColumn("last_seen", last).where((F.col("last_seen") <= F.lit(now) - F.make_dt_interval(F.lit(days))) & (F.col("tier") != "ORPHANED") & (F.col("state") != "REINFORCED"))
    return stale.orderBy("last_seen", "memory_id").limit(most).select("memory_id", "last_seen")
