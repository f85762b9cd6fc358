"""Every query with SQL against that SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

from docloom import catalog

ORACLES = catalog.oracle_sql()
#: These join the graph several times; the driver's correctness run covers the rest of their kind.
GRAPH_SAMPLE = {"build_edges", "search_full", "related_docs"}
GRAPH = {n for n, sql in ORACLES.items() if n not in GRAPH_SAMPLE and any(f"FROM {t}" in sql.rsplit("AS (", 1)[-1] or f"JOIN {t}" in sql.rsplit("AS (", 1)[-1] for t in ("edges", "ranked", "reached"))}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - GRAPH))
def test_query(spark, small, con, name):
    assert compare(catalog.queries()[name](spark, small), con, ORACLES[name]) == ""


def test_every_query_has_sql_or_reason():
    assert set(catalog.queries()) - set(ORACLES) <= {"clusters", "chunk_documents", "version_diff", "version_hunks", "search_previews"}
