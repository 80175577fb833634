"""What had been, had events not happened: excision replay and the cascade over decisions.

A dead event is one that is taken out. Chains that lose events are replayed from their birth, without rounding and without
trusting recorded confidence; all others keep their state. A decision dies if what it used falls out of what its
query would be served in that world; the events that it caused die with it, round by round, until nothing more dies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators import recall as R
from chronofold.operators.replay import lived
from chronofold.storage import written


def excised(chain: DataFrame, dead: DataFrame) -> DataFrame:
    """memory_id, custody_status, field_state, confidence of the chains (memory_id, seq, kind, to) that lose events (memory_id, seq).

    A chain that loses its birth is not there at all.
    """
    lost = chain.join(dead.select("memory_id").distinct(), "memory_id", "left_semi").join(dead, ["memory_id", "seq"], "left_anti")
    return lived(lost)


def world(memories: DataFrame, chain: DataFrame, dead: DataFrame) -> DataFrame:
    """The memories as they would be: replayed where events are dead, else as they are; unborn ones are gone."""
    again = excised(chain, dead)
    touched = dead.select("memory_id").distinct()
    same = memories.join(touched, "memory_id", "left_anti")
    other = memories.drop("custody_status", "field_state").join(again.select("memory_id", "custody_status", "field_state"), "memory_id")
    return same.unionByName(other.select(*memories.columns))


def cascade(memories: DataFrame, links: DataFrame, chain: DataFrame, decisions: DataFrame, dead: DataFrame, top_k: int = 5, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(dead events, dead decisions): memory_id, seq and decision_id of what falls with the first dead events.

    chain: memory_id, seq, kind, to, created_at, caused_by (a decision or null); decisions: decision_id, created_at, q, used.
    Only decisions after the first dead event are asked again.
    """
    spark = memories.sparkSession
    events = written(dead.select("memory_id", "seq").distinct())
    gone = written(spark.createDataFrame([], "decision_id long"))
    first = chain.join(events, ["memory_id", "seq"], "left_semi").agg(F.min("created_at")).first()[0]
    later = written(decisions.where(F.col("created_at") > F.lit(first)))
    while True:
        asked = later.join(gone, "decision_id", "left_anti")
        hits = R.recall(world(memories, chain, events), links, asked.select(F.col("decision_id").alias("query_id"), "q"), top_k, hops)
        used = asked.select("decision_id", F.explode("used").alias("memory_id"))
        served = hits.select(F.col("query_id").alias("decision_id"), "memory_id")
        fell = written(used.join(served, ["decision_id", "memory_id"], "left_anti").select("decision_id").distinct())
        if not fell.limit(1).count():
            return events, gone
        gone = written(gone.unionByName(fell))
        follow = chain.join(fell, chain["caused_by"] == fell["decision_id"], "left_semi").select("memory_id", "seq")
        events = written(events.unionByName(follow).distinct())
