import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from trackloom.plans import catalog


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols and got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
