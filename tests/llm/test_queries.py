"""The llm queries run on the smallest tables, where they are there, with the columns agreed on."""

import os

import pytest

from sparkloom.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {
    "p1_found": ["question_id_a bigint", "question_id_b bigint"], "p2_found": ["pair_kind string", "pair_id bigint", "defect string"], "p3_found": ["plan_id int", "attribute string", "category string"],
    "p5_found": ["idx bigint", "msg_pos int"], "p6_ids": ["doc_id bigint", "ids array<int>"], "p8_found": ["doc_id bigint"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA)
    if name in COLUMNS:
        assert [" ".join(x) for x in got.dtypes] == COLUMNS[name]
    first, again = (sorted(map(str, q.collect())) for q in (got, queries.queries()[name](spark, DATA)))
    assert first == again and (first or name in ("p3_found", "p3_below_need"))  # the same rows each time


def test_shortfalls_equal_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("questions", "sample_targets"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = {tuple(r) for r in queries.queries()["p3_found"](spark, DATA).collect()}
    assert got == set(c.sql(queries.oracle_sql()["p3_found"]).fetchall())
