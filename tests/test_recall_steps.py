"""A task of recall holds the sorts of one level of propagation, however many levels there are."""

import pytest

from chronofold.operators import recall as R


@pytest.mark.parametrize("hops", [1, 4])
def test_levels_end_in_tables(spark, hops):
    m = spark.createDataFrame([(i,) for i in range(9)], "memory_id long")
    links = spark.createDataFrame([(i, i + 1, "RESONANT") for i in range(8)], "from_id long, to_id long, link_type string")
    seeds = spark.createDataFrame([(7, 0, [])], "query_id long, seed long, without array<long>")
    state = R.propagate(seeds, links, m, hops)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan and "Exchange" not in plan
    assert state.first().hop == {i: i for i in range(hops + 1)}
