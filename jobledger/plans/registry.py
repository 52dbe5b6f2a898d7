"""Named queries over the tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobledger.plans.oracle import prelude

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` continues the common relations unless ``plain``."""
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql if plain else prelude(sql) + sql
        return function

    return add
