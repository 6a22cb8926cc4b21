"""Append-only landing tables, their union by name, manifests and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from undertone.operators.ranking import keep_latest

LINEAGE = ["_landed_at", "_source", "_snapshot_label"]


def land(df: DataFrame, folder: str, source: str, landed_at: str, label: str) -> bool:
    """Append rows with their lineage, partitioned by landing day; an empty batch writes nothing."""
    if df.isEmpty():
        return False
    stamped = df.withColumns({"_landed_at": F.lit(landed_at), "_source": F.lit(source), "_snapshot_label": F.lit(label), "_snapshot_date": F.lit(landed_at[:10])})
    stamped.write.mode("append").partitionBy("_snapshot_date").parquet(folder)
    return True


def scan(spark: SparkSession, folder: str, schema: StructType | None = None) -> DataFrame:
    """All landed files as one table, columns united by name; a missing folder is an empty table of ``schema``."""
    try:
        return spark.read.option("mergeSchema", True).parquet(folder)
    except Exception as e:  # noqa: BLE001 - only a missing path is forgiven
        if schema is not None and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per landed file: name, bytes, rows and lineage."""
    rows = spark.read.option("mergeSchema", True).parquet(folder).select("_metadata.file_name", "_metadata.file_size", *LINEAGE)
    return rows.groupBy("file_name").agg(F.first("file_size").alias("bytes"), F.count("*").alias("rows"), *[F.min(c).alias(c[1:]) for c in LINEAGE])


def cleansed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest landing of every key without lineage columns; equal stamps fall back to label and row hash."""
    plain = [c for c in df.columns if not c.startswith("_")]
    order = [F.desc_nulls_last("_landed_at"), F.desc_nulls_last("_snapshot_label"), F.xxhash64(*plain)]
    return keep_latest(df, keys, order).select(*plain)


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key.

    With ``order``, one whole row per key is kept, the first in that order of the
    newer batch. A missing key column is an error; null keys are left out.
    """
    for df in (old, new):
        if key not in df.columns:
            raise ValueError(f"no column {key}")
    both = union_by_name([old.withColumn("_batch", F.lit(0)), new.withColumn("_batch", F.lit(1))]).where(F.col(key).isNotNull())
    if order is None:
        fresh = new.select(key).distinct().withColumn("_fresh", F.lit(True))
        return both.join(fresh, key, "left").where((F.col("_batch") == 1) | F.col("_fresh").isNull()).drop("_batch", "_fresh")
    return keep_latest(both, [key], [F.desc("_batch"), *order]).drop("_batch")


def present(col: str, text: bool) -> Column:
    return F.when(F.trim(col) != "", F.col(col)) if text else F.col(col)


def last_known(df: DataFrame, key: str, order: list[str], texts: list[str], numbers: list[str]) -> DataFrame:
    """Per key the newest present value of every column; empty texts do not overwrite."""
    newest = F.struct(*order)
    picks = [F.max_by(c, F.when(present(c, text).isNotNull(), newest)).alias(c) for cols, text in ((texts, True), (numbers, False)) for c in cols]
    return df.groupBy(key).agg(*picks)
