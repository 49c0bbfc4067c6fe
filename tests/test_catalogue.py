"""Each relational query against its SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

from sparkloom.plans import catalogue, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = got.columns
    at = [want.columns.index(c) for c in cols]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
