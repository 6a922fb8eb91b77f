"""The queries that have SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from sinkweave.llm.queries import ORACLE_SQL, QUERIES

from ..core.test_oracles import TABLES, shown


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    frame = QUERIES[name](spark, sf)
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    order = sorted(columns)
    assert order == sorted(frame.columns)
    got = sorted(tuple(shown(r[c]) for c in order) for r in frame.collect())
    assert got == sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in result.fetchall())


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
