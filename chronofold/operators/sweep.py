"""As-of and interval joins as one sorted sweep: no pairs of rows, and no key in one task.

Both sides are put in one order of key and time. Rows are dealt by ranges of that order, so a hot key goes to many
tasks; each task carries a state along its rows of a key, and what a key's earlier tasks end with (one row a key and
task) is carried over to the later ones. So the work is a sort, whatever the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.storage import written


def _carried(rows: DataFrame, order: list[str], last: list[str], sums: list[str]) -> DataFrame:
    """Rows (key first in ``order``) with the last value not null, or the sum, of columns over all rows of the key up to them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("__key"), *map(F.col, order), F.col("__tie")]
    dealt = rows.withColumn("__tie", F.rand(3)).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__tie")
    dealt = written(dealt.withColumn("__id", F.monotonically_increasing_id()).withColumn("__of", F.shiftright("__id", 33)))
    here = W.partitionBy("__of", "__key").orderBy("__id").rowsBetween(W.unboundedPreceding, 0)
    tails = dealt.groupBy("__key", "__of").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__id"))).alias(c) for c in last], *[F.sum(c).alias(c) for c in sums])
    before = W.partitionBy("__key").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    over = tails.select("__key", "__of", *[F.last(c, True).over(before).alias(f"__{c}") for c in last], *[F.sum(c).over(before).alias(f"__{c}") for c in sums])
    told = dealt.withColumns({c: F.last(c, True).over(here) for c in last} | {c: F.sum(c).over(here) for c in sums}).join(over, ["__key", "__of"])
    return told.withColumns({c: F.coalesce(c, f"__{c}") for c in last} | {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0)) for c in sums})


def _key(keys: list[str]) -> Column:
    """One key of several columns; null where one is null, which matches nothing."""
    return F.when(~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.struct(*keys)).alias("__key")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: tuple[str, ...] = ()) -> DataFrame:
    """left, with ``found``: the row of right (a struct) of equal keys that is the last at or before left's time, or null.

    Rows of right at the same time stand by ``order``. A null key or time of left finds nothing, one of right is not found.
    """
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    rs, ls = right.select(F.struct(*right.columns).alias("x")).schema["x"].dataType, left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType
    lower = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    there = right.where(F.col(at).isNotNull()).select(_key(keys), F.col(at).alias("__at"), F.lit(0).alias("__side"), *lower, F.struct(*right.columns).alias("found"), none("__left", ls)).where("__key is not null")
    asked = left.select(_key(keys), F.col(at).alias("__at"), F.lit(1).alias("__side"), *[none(f"__o{i}", right.schema[c].dataType) for i, c in enumerate(order)], none("found", rs), F.struct(*left.columns).alias("__left"))
    matched = asked.where("__key is not null and __at is not null")
    told = _carried(there.unionByName(matched), ["__at", "__side", *[f"__o{i}" for i in range(len(order))]], ["found"], []).where("__side = 1").select("__left.*", "found")
    return told.unionByName(asked.where("__key is null or __at is null").select("__left.*", "found"))


def covered(events: DataFrame, intervals: dict[str, DataFrame], keys: list[str], at: str, since: str = "since", until: str = "until") -> DataFrame:
    """events, with a count for each name: how many of its intervals of equal keys hold at the event's time.

    Intervals are closed at the start and open at the end; an end of null never comes. A null key or time counts 0.
    """
    kind = events.select(F.struct(*events.columns).alias("x")).schema["x"].dataType
    names = list(intervals)
    asked = events.select(_key(keys), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*events.columns).alias("__row"), *[F.lit(0).cast("long").alias(n) for n in names])
    both = asked.where("__key is not null and __at is not null")
    for name, spans in intervals.items():
        spans = spans.where(F.col(since).isNotNull() & (F.col(until).isNull() | (F.col(until) > F.col(since))))
        for edge, step in ((since, 1), (until, -1)):
            rows = spans.where(F.col(edge).isNotNull()).groupBy(_key(keys), F.col(edge).alias("__at")).agg((F.count("*") * step).alias("__n"))  # one row an instant
            both = both.unionByName(rows.where("__key is not null").select("__key", "__at", F.lit(0).alias("__side"), F.lit(None).cast(kind).alias("__row"), *[(F.col("__n") if n == name else F.lit(0)).cast("long").alias(n) for n in names]))
    told = _carried(both, ["__at", "__side"], [], names).where("__side = 1").select("__row.*", *names)
    return told.unionByName(asked.where("__key is null or __at is null").select("__row.*", *names))
