"""The sections of a bundle are written once: what reads them does not hash the chains again (F11, F17)."""

from chronofold.plans import trials


def test_sections_are_read_not_made_again(spark):
    sections = trials.evidence(spark, "/root/testdata/sf0.001")
    assert {k: "MapInArrow" in df._jdf.queryExecution().toString() for k, df in sections.items()} == {"custody": False, "memories": False}
