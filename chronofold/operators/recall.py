"""Recall with links for many queries at once: seeds, propagation over links, inhibition, rescue, time travel and receipts.

Candidates are CLEAN (an override may set a memory's status), not FORGOTTEN, and have a length. The seed is the best
cosine, ties to the smallest id. Propagation runs level by level up to ``hops`` (10 at most), over links between CLEAN
memories. In a level nodes fire in order of id; a node that is inhibited by then, or has fired, does not. A firing node
gets the level as its hop; each RESONANT link of it adds 1/2 to its target's boost and each INHIBITORY one inhibits. The
next level has the targets that neither fired nor are inhibited. A candidate's multiplier is its state's boost times
0.86 to the power of its hop (1 if it never fired), plus its boost by links. Inhibited candidates are dropped, but
for the seed and REINFORCED ones, which are rescued.

Only candidates that propagation touches differ from their plain score, so a query needs its plain best, as many as are
served and touched together, and the touched ones. The plain best come from blocked products; what a query touches is
bounded by degree to the power of hops, not by the memories.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.operators import similarity
from chronofold.operators.replay import state_at
from chronofold.storage import written

#: Fixed values.
STATE_BOOST = {"REINFORCED": 1.5, "NEUTRAL": 1.0, "FORGOTTEN": 0.0}
DECAY, RESONANT_STEP, MOST_HOPS = 0.86, 0.5, 10
PROTOCOL, SLACK = "1.0.0", 32


def rescues(state: Column) -> Column:
    """Whether a memory of that state is ranked although it is inhibited."""
    return state == "REINFORCED"


def effective(memories: DataFrame, override: Mapping[int, str] | None = None) -> DataFrame:
    """The memories with the overriding status of those that have one."""
    if not override:
        return memories
    told = F.create_map(*[F.lit(x) for k, v in override.items() for x in (k, v)])
    return memories.withColumn("custody_status", F.coalesce(F.element_at(told, F.col("memory_id")), F.col("custody_status")))


def as_of(memories: DataFrame, chain: DataFrame, at) -> DataFrame:
    """The memories born by ``at``, with the status and the state that their chain (memory_id, seq, kind, to, created_at) had then.

    Today's columns tell nothing: a memory forgotten later was there, one promoted later was not yet.
    """
    return memories.drop("custody_status", "field_state").join(state_at(chain, at).drop("confidence"), "memory_id").select(*memories.columns)


def propagate(seeds: DataFrame, links: DataFrame, servable: DataFrame, hops: int) -> DataFrame:
    """query_id, seed, hop (map of node to level), boosts (map of node to 1/2 a link), inhibited (array).

    seeds: query_id, seed, and ``without``, the nodes that a query does without: they do not fire.
    """
    ok = servable.select("memory_id")
    live = links.join(ok.withColumnRenamed("memory_id", "from_id"), "from_id", "left_semi").join(ok.withColumnRenamed("memory_id", "to_id"), "to_id", "left_semi")
    targets = lambda kind: F.array_sort(F.collect_list(F.when(F.col("link_type") == kind, F.col("to_id"))))
    out = written(live.groupBy("from_id").agg(targets("RESONANT").alias("resonant"), targets("INHIBITORY").alias("inhibitory")))
    empty = F.array().cast("array<bigint>")
    state = written(seeds.select("query_id", "seed", "without", F.array("seed").alias("frontier"), empty.alias("fired"), F.array().cast("array<int>").alias("levels"), empty.alias("inhibited"), empty.alias("boosts")))
    kind = "array<struct<node:bigint,resonant:array<bigint>,inhibitory:array<bigint>>>"
    for level in range(min(hops, MOST_HOPS) + 1):
        around = state.select("query_id", F.explode("frontier").alias("node")).join(out, F.col("node") == F.col("from_id"), "left")
        nodes = around.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("node", F.coalesce("resonant", empty).alias("resonant"), F.coalesce("inhibitory", empty).alias("inhibitory")))).alias("nodes"))
        start = F.struct(F.col("inhibited").alias("inhibited"), empty.alias("fired"), empty.alias("next"))

        def fire(acc: Column, n: Column) -> Column:
            on = F.struct(F.concat(acc["inhibited"], n["inhibitory"]).alias("inhibited"), F.concat(acc["fired"], F.array(n["node"])).alias("fired"), F.concat(acc["next"], n["resonant"]).alias("next"))
            return F.when(F.array_contains(acc["inhibited"], n["node"]), acc).otherwise(on)

        state = state.join(nodes, "query_id", "left").withColumn("f", F.aggregate(F.coalesce("nodes", F.array().cast(kind)), start, fire))
        fired, inhibited = F.concat("fired", "f.fired"), F.array_distinct(F.col("f.inhibited"))
        state = state.select(
            "query_id", "seed", "without", F.array_except(F.array_except(F.array_except(F.col("f.next"), fired), inhibited), F.col("without")).alias("frontier"), fired.alias("fired"),
            F.concat("levels", F.array_repeat(F.lit(level), F.size("f.fired"))).alias("levels"),
            inhibited.alias("inhibited"), F.concat("boosts", "f.next").alias("boosts"),
        )
        state = written(state)  # a task holds the sorts of one level, however many levels there are
    return state.select("query_id", "seed", F.map_from_arrays("fired", "levels").alias("hop"), "boosts", "inhibited")


def scored(memories: DataFrame, links: DataFrame, queries: DataFrame, top_k: int = 5, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(hits, state): hits with query_id, memory_id, rank, score, hop, rescued; state of the propagation of each query.

    queries: query_id, q, and maybe ``without``, memories (ids) that are as good as absent for that query.
    """
    if "without" not in queries.columns:
        queries = queries.withColumn("without", F.array().cast("array<bigint>"))
    barred = queries.select("query_id", F.explode("without").alias("memory_id")).distinct()
    most_barred = queries.agg(F.max(F.size("without"))).first()[0] or 0
    clean = memories.where("custody_status = 'CLEAN'")
    boost = F.create_map(*[F.lit(x) for k, v in STATE_BOOST.items() for x in (k, v)])
    live = written(clean.where("field_state <> 'FORGOTTEN'").withColumn("weight", boost[F.col("field_state")]))
    near = similarity.best(live.withColumn("weight", F.lit(1.0)), queries, 1 + most_barred).join(barred, ["query_id", "memory_id"], "left_anti")
    first = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(similarity.key_column()), "memory_id"))).where("r = 1")
    seeds = first.select("query_id", F.col("memory_id").alias("seed")).join(queries.select("query_id", "without"), "query_id")
    state = propagate(seeds, links, clean, hops)
    touched = written(
        state.select("query_id", "seed", F.explode(F.array_distinct(F.concat(F.map_keys("hop"), "boosts", "inhibited"))).alias("memory_id"), "hop", "boosts", "inhibited")
        .select("query_id", "memory_id", F.coalesce(F.element_at("hop", F.col("memory_id")), F.lit(-1)).alias("hop"), (F.size(F.filter("boosts", lambda b: b == F.col("memory_id"))) * RESONANT_STEP).alias("boost"), (F.array_contains("inhibited", F.col("memory_id")) & (F.col("memory_id") != F.col("seed"))).alias("held"))
    )
    touched = touched.join(barred, ["query_id", "memory_id"], "left_anti")
    most = touched.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    plain = written(similarity.best(live, queries, top_k + max(most + most_barred, SLACK)))  # its sorts end here
    plain = plain.join(barred, ["query_id", "memory_id"], "left_anti").join(touched.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    plain = plain.withColumns({"hop": F.lit(-1), "rescued": F.lit(False)})
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, v: s + v)
    near = touched.join(live.select("memory_id", "v", "field_state", "weight"), "memory_id").join(queries.select("query_id", "q"), "query_id")
    near = near.where(~F.col("held") | rescues(F.col("field_state"))).withColumn("nv", dot("v", "v")).where("nv > 0")
    weight = F.col("weight") * F.when(F.col("hop") >= 0, F.pow(F.lit(DECAY), F.col("hop"))).otherwise(1.0) + F.col("boost")
    near = near.select("query_id", "memory_id", weight.alias("weight"), dot("q", "v").alias("d"), "nv", dot("q", "q").alias("nq"), "hop", F.col("held").alias("rescued"))
    both = plain.unionByName(near).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(similarity.key_column()), "memory_id")))
    x = F.col("d").cast("double") * F.col("weight")
    score = F.when(x > 0, F.round(x / F.sqrt(F.col("nv").cast("double") * F.col("nq")), 6)).otherwise(0.0)
    return both.where(F.col("rank") <= top_k).select("query_id", "memory_id", "rank", score.alias("score"), "hop", "rescued"), state


def recall(memories: DataFrame, links: DataFrame, queries: DataFrame, top_k: int = 5, hops: int = 2, override: Mapping[int, str] | None = None, at=None) -> DataFrame:
    """query_id, memory_id, rank, score, hop, rescued.

    memories: memory_id, custody_status, field_state, v (array<long>); links: from_id, to_id, link_type (and created_at,
    if ``at`` is given: later links do not count, and the memories are those of ``as_of``); queries: query_id, q (array<long>).
    """
    links = links if at is None else links.where(F.col("created_at") <= F.lit(at))
    return scored(effective(memories, override), links, queries, top_k, hops)[0]


def receipts(memories: DataFrame, links: DataFrame, queries: DataFrame, top_k: int = 5, hops: int = 2, override: Mapping[int, str] | None = None, at: str | None = None) -> DataFrame:
    """One sealed receipt a query: what was served in order, from which seed, and how many were left out and why."""
    links = links if at is None else links.where(F.col("created_at") <= F.lit(at))
    own = effective(memories, override)
    hits, state = scored(own, links, queries, top_k, hops)
    gone = own.agg(F.count_if(F.col("custody_status") != "CLEAN").alias("custody"), F.count_if((F.col("custody_status") == "CLEAN") & (F.col("field_state") == "FORGOTTEN")).alias("forgotten"))
    served = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"].cast("string")).alias("served"))
    held = state.select("query_id", "seed", F.explode_outer("inhibited").alias("memory_id")).join(own.where("custody_status = 'CLEAN'").select("memory_id", "field_state"), "memory_id", "left")
    held = held.groupBy("query_id", "seed").agg(F.count_if((F.col("field_state") == "NEUTRAL") & (F.col("memory_id") != F.col("seed"))).alias("inhibited"))
    r = queries.select("query_id", "q").join(served, "query_id", "left").join(held, "query_id", "left").join(F.broadcast(gone))  # one row
    listed = F.coalesce("served", F.array().cast("array<string>"))
    query_sha = C.sha256(F.concat(F.lit("["), F.array_join(F.transform("q", lambda x: x.cast("string")), ","), F.lit("]")))
    body = {
        "query_sha256": query_sha, "seed_memory_id": F.col("seed").cast("string"), "served": C.Raw(C.json_array(listed)), "excluded_custody": C.Number(F.col("custody")), "excluded_forgotten": C.Number(F.col("forgotten")),
        "excluded_inhibited": C.Number(F.coalesce("inhibited", F.lit(0))), "top_k": top_k, "hops": hops, "ranking_protocol": PROTOCOL, "custody_override": [[str(k), v] for k, v in sorted((override or {}).items(), key=lambda x: str(x[0]))], "as_of": at,
    }
    return r.select("query_id", F.col("seed").alias("seed_memory_id"), listed.alias("served"), F.col("custody").alias("excluded_custody"), F.col("forgotten").alias("excluded_forgotten"), F.coalesce("inhibited", F.lit(0)).alias("excluded_inhibited"), C.sha256(C.json_object(body)).alias("receipt_sha256"))
