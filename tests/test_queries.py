"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from korrel import queries
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, con, name):
    df = queries.queries()[name](spark, small)
    sql = queries.oracle_sql().get(name)
    if sql:
        same(df, con, sql)
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_custkey", "customer", "balance", "o_orderkey", "o_totalprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
