"""Registered queries against their SQL twins, and the contracts of those without."""

from __future__ import annotations

import pytest

from semtab.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None
