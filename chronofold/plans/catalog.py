"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import replay
from chronofold.operators.recall import recall
from chronofold.plans import checks, field, field_store, history, ledger, maintenance, relational, scalars, states, trials, vectors  # noqa: F401  some only register their queries
from chronofold.plans.dialect import oracle, query
from chronofold.streaming.signals import consensus

BODIES = {**relational.BODIES, **vectors.BODIES, **maintenance.BODIES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: query(v) for k, v in BODIES.items()}
ORACLE_SQL: dict[str, str] = {k: oracle(v) for k, v in BODIES.items()}
FLAGSHIP = "VEC-4_exact_recall"


def _model(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return query(f"select * from {view}")(spark, sf_dir)


def recall_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(_model(spark, sf_dir, "memories"), _model(spark, sf_dir, "links"), _model(spark, sf_dir, "queries"))


def custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.custody_replay(_model(spark, sf_dir, "chain"))


def excision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains without their first reinforcement."""
    chain = _model(spark, sf_dir, "chain")
    first = chain.where("kind = 'REINFORCED'").groupBy("subject").agg(F.min("seq").alias("seq"))
    return replay.excised_replay(chain, first)


def signal_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return consensus(events.select(F.col("user_id").alias("memory_id"), F.col("event_type").alias("origin"), F.least(F.col("value") / 100, F.lit(1.0)).alias("vigor"), F.col("ts").cast("timestamp").alias("created_at")))


#: Ordered folds and propagation, held against brute force in the tests.
QUERIES |= {
    "VEC-4_recall_with_links": recall_with_links,
    "WIN-6_custody_replay": custody,
    "GRF-6_excised_replay": excision,
    "STR-4_signal_consensus": signal_consensus,
}
QUERIES |= ledger.QUERIES
ORACLE_SQL |= ledger.ORACLES
