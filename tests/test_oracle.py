"""Every registered query against its DuckDB twin on the smallest tables (the driver uses sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_key
from tests.conftest import SF_SMALL

from rankspark.plans import catalog, catalog_more  # noqa: F401

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert not rows_only
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    assert sorted(cols) == sorted(rel.columns)
    drows = rel.fetchall()
    assert len(rows) == len(drows)
    assert rows_key(cols, rows) == rows_key(rel.columns, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "score" in df.columns
