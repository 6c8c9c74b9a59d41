"""Registered queries of the subpackage against their DuckDB twins on the smallest tables."""

import pytest

from rankspark.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import duck
from tools.oracle_check import rows_key


@pytest.fixture(scope="module")
def con():
    return duck()


def test_all_operators_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_key(df.columns, rows) == rows_key(rel.columns, rel.fetchall())
