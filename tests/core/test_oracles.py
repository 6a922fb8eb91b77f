"""Every registered query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sinkweave.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    return repr(float(f"{value:.9g}")) if isinstance(value, float) else repr(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    got = sorted(tuple(shown(r[c]) for c in order) for r in frame.collect())
    want = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert got == want
