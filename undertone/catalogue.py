"""Registry of the core queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from undertone.plans import aggregates, drift, entities, fixtures, gate, joins, learned, packed, pages, ranked, reports, scalars, scans  # noqa: F401
from undertone.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
