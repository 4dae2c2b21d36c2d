"""Named queries over the benchmark tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atlas.catalog.inputs import check

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a builder under its own name."""
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql:
            CHECKS[build.__name__] = check(sql)
        return build
    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Build a named query; an unknown name is a KeyError."""
    return QUERIES[name](spark, folder)
