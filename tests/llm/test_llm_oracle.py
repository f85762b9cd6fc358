"""The operators' queries that SQL can express, against that SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

from docloom.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, small, con, name):
    assert compare(queries()[name](spark, small), con, oracle_sql()[name]) == ""
