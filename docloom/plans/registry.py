"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.corpus import Corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Corpus], DataFrame]], Callable[[Corpus], DataFrame]]:
    """Register a function of the canonical tables under its name."""

    def add(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
