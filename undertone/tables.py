"""Access to the parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of ``<root>/<name>.parquet``; columns and filters are pushed down by Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")
