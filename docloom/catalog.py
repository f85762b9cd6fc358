"""Registered queries of the document engine and the SQL that must give the same rows."""

from __future__ import annotations

from docloom.plans import analytics_queries, audit_queries, file_queries, search_queries, state_queries, stream_queries, text_queries  # noqa: F401  (they register their queries)
from docloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
