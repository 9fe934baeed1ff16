"""Every suite query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    assert entry and len(queries()) > 100


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["l_orderkey_count"] and out.first()[0] > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF).count() > 0
    else:
        assert compare(spark, con, queries()[name], sql, SF) is None
