"""Registry that keeps every query next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan under its function name, with its SQL where SQL can express it."""

    def keep(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return keep
