"""Graphs by rounds: hops, exposure, blast radius, weighted propagation, paths and finite machines.

A round joins a frontier with the edges and keeps one row a node, so the work is bounded by edges times rounds; what is
carried from round to round is written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.storage import spread, written


def hops(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """id and hop (0 for seeds) of the nodes that ``most`` directed steps reach; edges: a, b; seeds: id."""
    edges = written(edges.select("a", "b").distinct())
    seen = frontier = written(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, most + 1):
        step = frontier.join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = written(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        seen = written(seen) if hop % 8 == 0 else seen  # few files, and a short plan
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def exposure(sources: DataFrame, edges: DataFrame, most: int = 6, transfer: float = 0.5, floor: float = 1 / 64) -> DataFrame:
    """id, depth and exposure: the best product of ``transfer`` along a path, which is that of the shortest one; sources are left out."""
    reach = hops(sources, edges, most).where("hop > 0")
    told = reach.select("id", F.col("hop").alias("depth"), F.pow(F.lit(transfer), F.col("hop")).alias("exposure"))
    return told.where(F.col("exposure") >= floor)


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids that directed steps reach, seeds among them."""
    return hops(seeds, edges, 1 << 30).select("id")


def blast_radius(seeds: DataFrame, uses: DataFrame, derived: DataFrame, succession: DataFrame, served: DataFrame | None = None, resonant: DataFrame | None = None) -> DataFrame:
    """kind (DECISION, MEMORY or RECEIPT), id, level and attested of what the seed memories may have affected.

    uses: decision_id, memory_id, actor; derived: memory_id, decision_id, actor (stored from a decision); succession: old, new.
    DIRECT decisions used a seed. DERIVED are the successors of affected memories, memories stored from affected decisions
    and decisions that used affected memories, to a fixpoint; a memory stored from a decision is attested if the same
    actor did both. POSSIBLE memories are not derived, but were served with a seed by one receipt (served: receipt_id,
    memory_id; those receipts are DIRECT) or are next to it (resonant: a, b); without receipts, were used with it.
    """
    uses = written(uses)
    direct = written(uses.join(seeds.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("decision_id").distinct())
    m = lambda c: F.shiftleft(F.col(c).cast("long"), 1)  # noqa: E731  a node is a number: even for memories, odd for decisions
    d = lambda c: F.shiftleft(F.col(c).cast("long"), 1) + 1
    own = F.shiftright("id", 1)
    edges = uses.select(m("memory_id").alias("a"), d("decision_id").alias("b")).unionByName(derived.select(d("decision_id").alias("a"), m("memory_id").alias("b"))).unionByName(succession.select(m("old").alias("a"), m("new").alias("b")))
    edges = spread(edges, uses.count(), "a", "b")
    reached = written(hops(seeds.select(m("id").alias("id")), edges, 1 << 30))
    after = reached.where("hop > 0")
    by = uses.groupBy("decision_id").agg(F.min("actor").alias("by"))
    signed = derived.join(by, "decision_id", "left").withColumn("node", m("memory_id")).join(reached.select(F.col("id").alias("cause")), d("decision_id") == F.col("cause"), "left_semi")
    attested = signed.groupBy("node").agg(F.bool_or(F.coalesce(F.col("actor") == F.col("by"), F.lit(False))).alias("attested"))
    told = after.join(attested, after["id"] == attested["node"], "left").join(direct.select(d("decision_id").alias("x")), F.col("id") == F.col("x"), "left")
    kind = F.when(F.col("id") % 2 == 0, "MEMORY").otherwise("DECISION")
    level = F.when(F.col("x").isNotNull(), "DIRECT").otherwise("DERIVED")
    found = told.select(kind.alias("kind"), own.alias("id"), level.alias("level"), F.when(kind == "MEMORY", F.coalesce("attested", F.lit(True))).alias("attested"))
    near = uses.join(direct, "decision_id", "left_semi").select(m("memory_id").alias("id"))
    if served is not None:
        told = written(served.join(seeds.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("receipt_id").distinct())
        near = served.join(told, "receipt_id", "left_semi").select(m("memory_id").alias("id"))
        found = found.unionByName(told.select(F.lit("RECEIPT").alias("kind"), F.col("receipt_id").cast("long").alias("id"), F.lit("DIRECT").alias("level"), F.lit(None).cast("boolean").alias("attested")))
    if resonant is not None:
        near = near.unionByName(resonant.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select(m("b").alias("id")))
    near = near.distinct().join(reached.select("id"), "id", "left_anti")
    return found.unionByName(near.select(F.lit("MEMORY").alias("kind"), own.alias("id"), F.lit("POSSIBLE").alias("level"), F.lit(None).cast("boolean").alias("attested")))


def propagated(values: DataFrame, edges: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """id and total: the values (id, x) and what weighted edges (a, b, w) carry of them, along all paths of up to ``most`` steps.

    On a graph without cycles it ends by itself and is exact; with cycles of weights below 1 it stops once every
    contribution is ``least`` or less, the solution of x = b + W x within the contraction bound.
    """
    total = wave = written(values.select("id", F.col("x").cast("double").alias("x")))
    for _ in range(most):
        wave = written(wave.join(edges, F.col("id") == F.col("a")).groupBy("b").agg(F.sum(F.col("x") * F.col("w")).alias("x")).withColumnRenamed("b", "id"))
        if (wave.agg(F.max(F.abs("x"))).first()[0] or 0.0) <= least:
            break
        total = total.unionByName(wave)
    return total.groupBy("id").agg(F.sum("x").alias("total"))


def simple_paths(start: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """path (array) of all simple paths of 1 to ``most`` steps from the start ids."""
    paths = start.select(F.array("id").alias("path"))
    out = None
    for _ in range(most):
        paths = paths.join(edges, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
        out = paths if out is None else out.unionByName(paths)
    return out


def refined(machine: DataFrame, most: int = 1 << 20) -> tuple[DataFrame, int]:
    """(state, colour, and round_i, the colour after each round; rounds) of a machine (state, output, next0, next1).

    Moore's refinement: states of equal colour, output and successors' colours stay together, until the number of colours
    holds. A colour is the smallest state that has it.
    """
    rounds = written(machine.select("state", "next0", "next1", F.min("state").over(_by("output")).alias("round_0")))
    n, i = rounds.select("round_0").distinct().count(), 0
    while i < most:
        c = f"round_{i}"
        a, b = (rounds.select(F.col("state").alias(f"next{k}"), F.col(c).alias(f"c{k}")) for k in (0, 1))
        new = rounds.join(a, "next0").join(b, "next1").withColumn(f"round_{i + 1}", F.min("state").over(_by(c, "c0", "c1"))).drop("c0", "c1")
        rounds, i = written(new), i + 1
        now = rounds.select(f"round_{i}").distinct().count()
        if now == n:
            break
        n = now
    return rounds.withColumn("colour", F.col(f"round_{i}")), i


def _by(*keys: str):
    from pyspark.sql import Window as W

    return W.partitionBy(*keys)
