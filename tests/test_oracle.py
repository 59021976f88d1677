"""Every query of the synchronisation part equals its DuckDB oracle on the smallest driver tables.

(Queries of optional subpackages are tested beside them.)
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from relaysync.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events", "pages"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    sql = E.oracle_sql().get(name)
    assert sql is not None, f"{name} has no oracle"
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=_key)
    assert got == want


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["request_id", "route", "method", "uri", "content_location", "base_url"]
