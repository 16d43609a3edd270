"""Every query that SQL can express gives the rows of its SQL."""

import os

import duckdb
import pytest

from velum.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal(spark, db, name):
    got, want = registry.queries()[name](spark, SF), db.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in order)) for r in got.collect())
    assert rows == sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert len(registry.queries()[name](spark, SF).collect()) > 0
