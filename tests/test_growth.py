"""Steps whose cost must not outgrow their input."""

import re

from chronofold import storage
from chronofold.functions import text as T
from chronofold.plans import catalog
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_single_ablation_is_a_blocked_product(spark):
    assert "MapInArrow" in _plan(catalog.QUERIES["GRF-11_single_ablation"](spark, DATA))


def test_both_sides_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_A_TASK", 500, raising=False)
    plan = _plan(catalog.QUERIES["JOIN-9_bilateral"](spark, DATA))
    parts = [int(n) for n in re.findall(r"hashpartitioning\(decision_id#\d+L?, memory_id#\d+L?, (\d+)\)", plan)]
    assert max(parts) >= 12 and "REPARTITION_BY_NUM" in plan


def test_function_words_are_found_once(spark):
    """The words of a text stand once in the plan, not once for each of its columns and distinct words."""
    df = spark.createDataFrame([(1, "The cat, and the dog. El gato y la casa! " * 40), (2, None), (3, "...")], "doc_id long, text string")
    told = df.select("doc_id", T.style(F.col("text")).alias("s")).select("doc_id", F.size("s.words").alias("n"), F.element_at("s.words", F.lit("the")).alias("the"), "s.language", "s.sentence")
    assert str(told._jdf.queryExecution().optimizedPlan()).count("split(lower") == 1
    assert [tuple(r) for r in told.orderBy("doc_id").collect()] == [(1, 5, 0.2, "und", 5.0), (2, 0, None, "und", 0.0), (3, 0, None, "und", 0.0)]


def test_both_sides_meet_without_another_shuffle(spark):
    plan = catalog.QUERIES["JOIN-9_bilateral"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")
