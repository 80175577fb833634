"""Each query of the catalog against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from chronofold.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    sql = catalog.ORACLE_SQL[name]
    assert sorted(db.sql(sql).columns) == cols
    want = db.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
    assert rows(map(tuple, df.select(*cols).collect())) == rows(want)
