"""Agent-side recall: activation that spreads from the nearest memory over neighbours and typed links, and why others are absent.

For each query the seed is the nearest active memory. Level by level, each active node of the frontier (in order of id, unless
it is inhibited by then) activates its nearest neighbours and the targets of its links; RESONANT links also lift their
target, INHIBITORY ones silence it. The first level that arrives is a node's hop. REINFORCED memories are rescued
from inhibition, and count as active. Only what became active is scored:

    cosine * boost of the state * exp(-0.15 hop) + lift * min(cosine, 1) + 0.3 * synapses + recency

A rescued memory that no level reached takes its hop from a walk of up to ten steps over neighbours and RESONANT links, and
none if that does not reach it. Memories that the turn's memories pull by a synapse of 0.5 or more join at 0.3 of its
weight. State by state a query holds what it reached, which degree and hops bound, not the memories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators import similarity
from chronofold.storage import written

#: Fixed values.
STATE_BOOST = {"REINFORCED": 1.5, "NEUTRAL": 1.0, "FORGOTTEN": 0.0}
HOP_SCALE, LIFT, SYNAPSE, PULL, RECENCY, HALF_LIFE_S, FARTHEST = 0.15, 0.5, 0.3, 0.5, 0.05, 86400.0, 10
_IDS = "array<bigint>"


@dataclass(frozen=True)
class Outcome:
    """hits: query_id, memory_id, rank, score, similarity, hop, source; scored: the same without a limit of rank; state: what
    propagation left of each query; dropped: query_id, memory_id, reason of what was reached and left out."""

    hits: DataFrame
    scored: DataFrame
    state: DataFrame
    dropped: DataFrame


def _empty() -> Column:
    return F.array().cast(_IDS)


def spread(seeds: DataFrame, near: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """seeds (query_id, seed, without) with active, inhibited, lifts (a node for each RESONANT link) and hop (map)."""
    kind = lambda k: F.collect_list(F.when(F.col("link_type") == k, F.col("to_id")))
    other = F.collect_list(F.when(~F.col("link_type").isin("RESONANT", "INHIBITORY"), F.col("to_id")))
    edges = near.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("NEAR").alias("link_type")).unionByName(links.select("from_id", "to_id", "link_type"))
    out = written(edges.groupBy("from_id").agg(other.alias("plain"), kind("RESONANT").alias("resonant"), kind("INHIBITORY").alias("inhibitory")))
    state = seeds.select("query_id", "seed", "without", F.array("seed").alias("frontier"), _empty().alias("active"), _empty().alias("inhibited"), _empty().alias("lifts"), F.array("seed").alias("met"), F.array(F.lit(0)).alias("levels"))
    lists = ["plain", "resonant", "inhibitory"]
    shape = "array<struct<node:bigint," + ",".join(f"{c}:{_IDS}" for c in lists) + ">>"
    for level in range(hops + 1):
        around = state.select("query_id", "without", F.explode("frontier").alias("node")).join(out, F.col("node") == F.col("from_id"), "left")
        kept = [F.filter(F.coalesce(c, _empty()), lambda x: ~F.array_contains(F.col("without"), x)).alias(c) for c in lists]
        nodes = around.select("query_id", F.struct("node", *kept).alias("n")).groupBy("query_id").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
        start = F.struct(F.col("inhibited").alias("inhibited"), _empty().alias("fired"), _empty().alias("next"), _empty().alias("lifts"))

        def fire(acc: Column, n: Column) -> Column:
            on = F.struct(F.concat(acc["inhibited"], n["inhibitory"]).alias("inhibited"), F.concat(acc["fired"], F.array(n["node"])).alias("fired"), F.concat(acc["next"], n["plain"], n["resonant"]).alias("next"), F.concat(acc["lifts"], n["resonant"]).alias("lifts"))
            return F.when(F.array_contains(acc["inhibited"], n["node"]), acc).otherwise(on)

        state = state.join(nodes, "query_id", "left").withColumn("f", F.aggregate(F.coalesce("nodes", F.array().cast(shape)), start, fire))
        active, inhibited, new = F.concat("active", "f.fired"), F.array_distinct("f.inhibited"), F.array_except("f.next", "met")
        state = state.select(
            "query_id", "seed", "without", F.array_except(F.array_except(F.array_except("f.next", active), inhibited), F.col("without")).alias("frontier"), active.alias("active"), inhibited.alias("inhibited"),
            F.concat("lifts", "f.lifts").alias("lifts"), F.concat("met", new).alias("met"), F.concat("levels", F.array_repeat(F.lit(level + 1), F.size(new))).alias("levels"),
        )
    return state.select("query_id", "seed", "without", "active", "inhibited", "lifts", F.map_from_arrays("met", "levels").alias("hop"))


def _walked(pairs: DataFrame, near: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, memory_id, steps: the least steps (FARTHEST at most) from the seeds of pairs (query_id, seed, memory_id).

    Steps are taken from both ends, each time by the end whose frontier is smaller, until the two meet: what is visited goes
    with the degree to the power of half the distance, not with the memories. Pairs that met are looked for no longer.
    """
    edges = written(near.select("a", "b").unionByName(links.where("link_type = 'RESONANT'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))).distinct())
    pairs = written(pairs.select("query_id", "seed", "memory_id").distinct())
    wanted = written(pairs.select("seed", "memory_id").distinct())
    step = {"seed": edges, "memory_id": edges.select(F.col("b").alias("a"), F.col("a").alias("b"))}
    seen = {end: wanted.select(F.col(end), F.col(end).alias("id")).distinct() for end in step}
    front, found = dict(seen), None
    size = {end: front[end].count() for end in step}
    for steps in range(1, FARTHEST + 1 if size["seed"] else 1):
        end = min(size, key=lambda x: size[x])
        other = "memory_id" if end == "seed" else "seed"
        front[end] = written(front[end].join(step[end], F.col("id") == F.col("a")).select(end, F.col("b").alias("id")).distinct().join(seen[end], [end, "id"], "left_anti"))
        size[end] = front[end].count()
        if not size[end]:
            break
        seen[end] = seen[end].unionByName(front[end])
        met = written(wanted.join(front[end], end).join(front[other], [other, "id"], "left_semi").select("seed", "memory_id").distinct().withColumn("steps", F.lit(steps)))
        if not met.limit(1).count():
            continue
        found = met if found is None else found.unionByName(met)
        wanted = written(wanted.join(met, ["seed", "memory_id"], "left_anti"))  # a pair is met once
        if not wanted.limit(1).count():
            break
        for e in step:
            front[e] = written(front[e].join(wanted.select(e).distinct(), e, "left_semi"))
            size[e] = front[e].count()
    return pairs.join(found, ["seed", "memory_id"]).select("query_id", "memory_id", "steps") if found is not None else pairs.limit(0).select("query_id", "memory_id", F.lit(0).alias("steps"))


def recall(memories: DataFrame, near: DataFrame, links: DataFrame, queries: DataFrame, now: float, top_k: int = 5, hops: int = 2, turn: DataFrame | None = None, synapses: DataFrame | None = None, tampered: DataFrame | None = None) -> Outcome:
    """The best of what becomes active for each query, and what was reached but left out.

    memories: memory_id, field_state, layer, v (array<long>), last_activation (seconds, 0 for none); near: a, b, the
    neighbour graph of memories that are not FORGOTTEN; links: from_id, to_id, link_type; queries: query_id, q (array<long>),
    and maybe layer (only memories of it) and without (ids that are silenced). turn: query_id, memory_id, the memories of the
    current turn; synapses: from_id, to_id, weight; tampered: memory_id of texts that their author's style rejects.
    """
    queries = queries.select("query_id", "q", (F.col("layer") if "layer" in queries.columns else F.lit(None).cast("string")).alias("wanted"), (F.col("without") if "without" in queries.columns else _empty()).alias("without"))
    spark = memories.sparkSession
    turn = spark.createDataFrame([], "query_id long, memory_id long") if turn is None else turn
    synapses = spark.createDataFrame([], "from_id long, to_id long, weight double") if synapses is None else synapses
    tampered = spark.createDataFrame([], "memory_id long") if tampered is None else tampered
    silenced = queries.select("query_id", F.explode("without").alias("memory_id")).distinct()
    most = queries.agg(F.max(F.size("without"))).first()[0] or 0
    live = memories.where("field_state <> 'FORGOTTEN'").withColumn("weight", F.lit(1.0))
    first = similarity.best(live, queries, 1 + most, "near").join(silenced, ["query_id", "memory_id"], "left_anti")
    first = first.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(similarity.key_column("near")), "memory_id"))).where("r = 1")
    state = written(spread(first.select("query_id", F.col("memory_id").alias("seed")).join(queries.select("query_id", "without"), "query_id"), near, links, hops))

    kinds = memories.select("memory_id", "field_state", "layer", "v", "last_activation")
    held = state.select("query_id", F.explode("inhibited").alias("memory_id")).join(kinds, "memory_id")
    rescued = held.where("field_state = 'REINFORCED'").select("query_id", "memory_id")
    active = written(state.select("query_id", F.explode("active").alias("memory_id")).unionByName(rescued).distinct())
    barred = held.where("field_state <> 'REINFORCED'").select("query_id", "memory_id", F.lit("INHIBITED").alias("reason"))

    known = active.join(kinds, "memory_id").join(queries, "query_id").join(state.select("query_id", "seed", "inhibited", "lifts", "hop"), "query_id").join(tampered.select("memory_id", F.lit(True).alias("bad")).distinct(), "memory_id", "left")
    reason = (
        F.when(F.col("wanted").isNotNull() & ~F.col("layer").eqNullSafe(F.col("wanted")), "LAYER_FILTER").when(F.col("field_state") == "FORGOTTEN", "STATE_FILTER")
        .when(F.array_contains("inhibited", F.col("memory_id")) & (F.col("field_state") != "REINFORCED") & (F.col("memory_id") != F.col("seed")), "INHIBITED").when(F.col("bad"), "STYLOMETRY")
    )
    judged = written(known.withColumn("reason", reason).withColumn("hops", F.element_at("hop", F.col("memory_id"))).drop("hop", "inhibited", "bad", "layer", "wanted"))
    far = judged.where("reason is null and hops is null").select("query_id", "seed", "memory_id")
    ranked = judged.where("reason is null").join(_walked(far, near, links), ["query_id", "memory_id"], "left").withColumn("hop", F.coalesce("hops", "steps", F.lit(-1)))

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v"))
    sim = F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("q", "v") / norm))).otherwise(0.0)
    boost = F.create_map(*[F.lit(x) for k, v in STATE_BOOST.items() for x in (k, v)])
    pulls = turn.select("query_id", F.col("memory_id").alias("to_id")).join(synapses.groupBy("from_id", "to_id").agg(F.max("weight").alias("weight")), "to_id")
    own = pulls.groupBy("query_id", F.col("from_id").alias("memory_id")).agg(F.sum("weight").alias("synapse"))
    ranked = ranked.join(own, ["query_id", "memory_id"], "left").withColumn("similarity", sim)
    lift = F.size(F.filter("lifts", lambda x: x == F.col("memory_id"))) * LIFT
    fresh = F.when(F.col("last_activation") > 0, RECENCY * F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0.0), F.lit(now) - F.col("last_activation")) / HALF_LIFE_S)).otherwise(0.0)
    decay = F.when(F.col("hop") >= 0, F.exp(-HOP_SCALE * F.col("hop"))).otherwise(1.0)
    score = F.col("similarity") * boost[F.col("field_state")] * decay + lift * F.least("similarity", F.lit(1.0)) + F.coalesce("synapse", F.lit(0.0)) * SYNAPSE + fresh
    told = ranked.select("query_id", "memory_id", F.greatest(F.lit(0.0), score).alias("score"), "similarity", "hop", F.lit("similarity").alias("source"))

    strong = turn.select("query_id", F.col("memory_id").alias("from_id")).join(synapses, "from_id").where(F.col("weight") >= PULL).groupBy("query_id", F.col("to_id").alias("memory_id")).agg(F.max("weight").alias("weight"))
    strong = strong.join(told, ["query_id", "memory_id"], "left_anti").join(barred, ["query_id", "memory_id"], "left_anti").join(silenced, ["query_id", "memory_id"], "left_anti")
    strong = strong.join(kinds.where("field_state <> 'FORGOTTEN'").select("memory_id"), "memory_id", "left_semi").join(state.select("query_id"), "query_id", "left_semi")
    pulled = strong.select("query_id", "memory_id", (F.col("weight") * SYNAPSE).alias("score"), F.lit(0.0).alias("similarity"), F.lit(-1).alias("hop"), F.lit("synaptic").alias("source"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    scored = written(told.unionByName(pulled).withColumn("rank", order))
    hits = scored.where(F.col("rank") <= top_k)
    below = scored.where(F.col("rank") > top_k).select("query_id", "memory_id", F.lit("BELOW_TOP_K").alias("reason"))
    left_out = judged.where("reason is not null").select("query_id", "memory_id", "reason")  # what a reached memory is judged by goes before its inhibition
    dropped = barred.join(left_out, ["query_id", "memory_id"], "left_anti").unionByName(silenced.join(memories.select("memory_id"), "memory_id", "left_semi").select("query_id", "memory_id", F.lit("DIRECT_SUPPRESSION").alias("reason")))
    dropped = dropped.unionByName(left_out).distinct().join(scored.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti").unionByName(below)
    return Outcome(hits, scored, state, written(dropped))


def absences(outcome: Outcome, memories: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (query_id, memory_id, and maybe the memory's field_state) with the one reason why each is not served, null for those that are.

    A reason that the recall met goes first; a memory that is unknown or FORGOTTEN is NOT_IN_FIELD, any other UNREACHABLE.
    """
    served = outcome.hits.select("query_id", "memory_id", F.lit("SERVED").alias("reason"))
    met = served.unionByName(outcome.dropped.join(served, ["query_id", "memory_id"], "left_anti"))
    told = asked.join(met, ["query_id", "memory_id"], "left")
    told = told if "field_state" in asked.columns else told.join(memories.select("memory_id", "field_state"), "memory_id", "left")
    gone = F.col("field_state").isNull() | (F.col("field_state") == "FORGOTTEN")
    return told.select("query_id", "memory_id", F.when(F.col("reason") != "SERVED", F.col("reason")).when(F.col("reason").isNull(), F.when(gone, "NOT_IN_FIELD").otherwise("UNREACHABLE")).alias("reason"))


def effects(outcome: Outcome, now: float, turn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a recall leaves behind: activations (memory_id, last_activation), and the turns that synapses learn from.

    The second has session, turn and ids (array<string>): the current turn's memories, then those served.
    """
    used = outcome.hits.select("memory_id").distinct().withColumn("last_activation", F.lit(now))
    ids = lambda df, n: df.groupBy(F.col("query_id").alias("session")).agg(F.array_sort(F.collect_set(F.col("memory_id").cast("string"))).alias("ids")).withColumn("turn", F.lit(n))
    return used, ids(turn, 0).unionByName(ids(outcome.hits, 1))
