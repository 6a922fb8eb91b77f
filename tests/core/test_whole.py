"""Queries without SQL over whole tables."""

import os

import duckdb
import pytest

from sinkweave.plans.queries import ORACLE_SQL, QUERIES

from .test_oracles import TABLES


def test_no_sql_filters_ids():
    assert not [n for n, sql in ORACLE_SQL.items() if any(x in sql for x in ("orderkey % 10 = 0", "orderkey % 20 = 0", "ordinal % 7 = 0", "LIKE 'part.%'", "LIKE '%7'"))]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", ["rendered_traces", "triaged_traces"])
def test_every_order_with_lines_is_a_trace(spark, sf, duck, name):
    want = sorted(k for (k,) in duck.execute("SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey").fetchall())
    assert sorted(r["trace_id"] for r in QUERIES[name](spark, sf).select("trace_id").collect()) == want
