"""Silencing memories in batch: which sets a served memory depends on, and whether rescue holds under random silencing.

Each silenced set of each query is a query of its own that does ``without`` those memories, so all of them are answered by
one recall. A set is a bit mask over the query's candidates; what matters are the smallest sets that break the rule.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators import recall as R
from chronofold.storage import positioned, written

REDUNDANT, SINGLE, MULTIPLE, NONE = "REDUNDANT_PATHS", "SINGLE_NECESSARY", "MULTIPLE_NECESSARY", "NO_DEPENDENCE"


def silenced(memories: DataFrame, links: DataFrame, asked: DataFrame, top_k: int, hops: int) -> tuple[DataFrame, DataFrame]:
    """(trials, hits): the trials (trial, q, without, and what else ``asked`` has), and trial, memory_id, rank, hop of what each is served."""
    order = [F.col(c) for c in asked.columns if c not in ("q", "without")]
    trials = written(positioned(asked, order, "trial"))
    hits = R.recall(memories, links, trials.select(F.col("trial").alias("query_id"), "q", "without"), top_k, hops)
    return trials, written(hits.select(F.col("query_id").alias("trial"), "memory_id", "rank", "hop"))


def dependence(memories: DataFrame, links: DataFrame, queries: DataFrame, candidates: DataFrame, top_k: int = 5, hops: int = 2, most: int = 2) -> DataFrame:
    """query_id, watched, verdict, killers: what each served memory depends on among its query's candidates (query_id, memory_id).

    All sets of 1 to ``most`` other candidates are silenced; a set kills if the watched memory is then not served. No set:
    NO_DEPENDENCE; exactly one single: SINGLE_NECESSARY; several: MULTIPLE_NECESSARY; only larger sets: REDUNDANT_PATHS.
    killers are the smallest sets, those of which no part kills. Candidates are a short list of a query.
    """
    short = candidates.groupBy("query_id").agg(F.array_sort(F.collect_set("memory_id")).alias("ids"))
    size = short.agg(F.max(F.size("ids"))).first()[0] or 0
    masks = F.array(*[F.lit(sum(1 << i for i in x)).cast("long") for n in range(1, most + 1) for x in combinations(range(size), n)] or [F.lit(0).cast("long")])
    fits = F.filter(masks, lambda m: (m > 0) & (m < F.call_function("shiftleft", F.lit(1).cast("long"), F.size("ids"))))
    sets = short.select("query_id", "ids", F.explode(fits).alias("mask"))
    bit = lambda mask, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1
    sets = sets.select("query_id", "mask", "ids", F.filter("ids", lambda x, i: bit(F.col("mask"), i)).alias("without"))
    base = written(R.recall(memories, links, queries.select("query_id", "q"), top_k, hops).select("query_id", F.col("memory_id").alias("watched")))
    trials, hits = silenced(memories, links, sets.drop("ids").join(queries.select("query_id", "q"), "query_id"), top_k, hops)
    kept = trials.join(hits, "trial").select("query_id", "mask", F.col("memory_id").alias("watched"))
    tried = trials.join(base, "query_id").where(~F.array_contains("without", F.col("watched"))).select("query_id", "mask", "watched", "without")
    kills = tried.join(kept, ["query_id", "mask", "watched"], "left_anti")
    per = kills.groupBy("query_id", "watched").agg(F.collect_list(F.struct("mask", "without")).alias("sets"))
    part = lambda m, x: (x["mask"] != m["mask"]) & (x["mask"].bitwiseAND(m["mask"]) == x["mask"])
    least = F.filter("sets", lambda m: ~F.exists("sets", lambda x: part(m, x)))
    told = base.join(per, ["query_id", "watched"], "left").withColumn("least", F.array_sort(F.transform(least, lambda m: m["without"])))
    singles = F.size(F.filter("least", lambda x: F.size(x) == 1))
    verdict = F.when(F.col("least").isNull(), NONE).when(singles == 1, SINGLE).when(singles > 1, MULTIPLE).otherwise(REDUNDANT)
    return told.select("query_id", "watched", verdict.alias("verdict"), F.coalesce("least", F.array().cast("array<array<bigint>>")).alias("killers"))


def rescue_fuzz(memories: DataFrame, links: DataFrame, queries: DataFrame, size: int = 2, trials: int = 25, seed: str = "42", top_k: int = 5, hops: int = 2) -> DataFrame:
    """query_id, draw, suppressed, memory_id, reason: REINFORCED memories that leave a query's result when NEUTRAL ones are silenced.

    A draw silences the ``size`` NEUTRAL memories of the least keyed hashes of those that the query touches or serves; equal
    draws of a query count once. An exit by inhibition (INHIBITED) would break the rule that rescues REINFORCED memories;
    OUTRANKED ones were reached and passed by others, UNREACHABLE ones lost the path that lifted them.
    """
    hits, state = R.scored(memories, links, queries.select("query_id", "q"), top_k, hops)
    hits = written(hits)
    reached = state.select("query_id", F.explode(F.array_distinct(F.concat(F.map_keys("hop"), "boosts", "inhibited"))).alias("memory_id"))
    near = reached.unionByName(hits.select("query_id", "memory_id")).distinct()
    kinds = memories.where("custody_status = 'CLEAN'").select("memory_id", "field_state")
    pool = near.join(kinds.where("field_state = 'NEUTRAL'"), "memory_id").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ("query_id", "draw", "memory_id")]), 256)
    first = pool.withColumn("n", F.row_number().over(W.partitionBy("query_id", "draw").orderBy(drawn))).where(F.col("n") <= size)
    sets = first.groupBy("query_id", "draw").agg(F.array_sort(F.collect_list("memory_id")).alias("without")).where(F.size("without") == size)
    sets = sets.groupBy("query_id", "without").agg(F.min("draw").alias("draw"))
    asked, after = silenced(memories, links, sets.join(queries.select("query_id", "q"), "query_id"), top_k, hops)
    watched = hits.join(kinds.where("field_state = 'REINFORCED'"), "memory_id").select("query_id", "memory_id", "hop")
    tried = asked.select("trial", "query_id", "draw", F.col("without").alias("suppressed")).join(watched, "query_id")
    gone = written(tried.join(after.select("trial", "memory_id"), ["trial", "memory_id"], "left_anti"))
    broken = asked.join(gone.select("trial").distinct(), "trial", "left_semi").select(F.col("trial").alias("query_id"), "q", "without")
    _, state = R.scored(memories, links, broken, top_k, hops)
    again = state.select(F.col("query_id").alias("trial"), "hop", "boosts", "inhibited", "seed").withColumnRenamed("hop", "hops")
    told = gone.join(again, "trial", "left")
    lifted = F.map_contains_key("hops", F.col("memory_id")) | F.array_contains("boosts", F.col("memory_id"))
    # a REINFORCED memory that is inhibited is rescued and ranked; it could only leave by inhibition were it not told among the ranked
    held = F.array_contains("inhibited", F.col("memory_id")) & ~R.rescues(F.lit("REINFORCED"))
    reason = F.when(held, "INHIBITED").when((F.col("hop") >= 0) & ~F.coalesce(lifted, F.lit(False)), "UNREACHABLE").otherwise("OUTRANKED")
    return told.select("query_id", "draw", "suppressed", "memory_id", reason.alias("reason"))
