"""Every core query against its SQL on the smallest tables, where they are there."""

import glob
import math
import os

import pytest

from sparkloom.plans import core_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(frame):
    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return None
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)]
    found = [tuple(plain(x) for x in r) for r in frame.astype(object).values.tolist()]
    return sorted(found, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core_queries.queries()))
def test_query(spark, duck, name):
    got = core_queries.queries()[name](spark, DATA)
    sql = core_queries.oracle_sql().get(name)
    if sql is None:
        got.toPandas()
        return
    expected = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.toPandas()) == rows(expected)
