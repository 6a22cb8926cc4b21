"""Aggregation operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions.numbers import clean


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form: one row per key and column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keys, F.inline(pairs))


def centroids(df: DataFrame, group: list[str], columns: list[str], spread: bool = False) -> DataFrame:
    """Mean of every column per group, NaN skipped as null; with ``spread`` also sample deviations."""
    aggs = [F.avg(clean(F.col(c))).alias(c) for c in columns]
    if spread:
        aggs += [F.stddev_samp(clean(F.col(c))).alias(f"{c}_std_within") for c in columns]
    return df.groupBy(*group).agg(F.count("*").alias("track_count"), *aggs)


def sigma_shift(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """RMS over features of the distance between group means in corpus sample deviations.

    Rows ``(group_a, group_b, shift)`` for every pair of groups, a before b. A
    constant feature contributes 0. Group means are single precision, as the
    metric is defined on stored centroids.
    """
    stats = df.agg(*[F.avg(clean(F.col(c))).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(clean(F.col(c))).alias(f"s{i}") for i, c in enumerate(columns)])
    means = centroids(df, [group], columns)
    z = [
        F.when(F.col(f"s{i}") > 1e-12, (F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)).cast("float").alias(c)
        for i, c in enumerate(columns)
    ]
    scaled = means.join(F.broadcast(stats), F.lit(True)).select(F.col(group), F.array(*z).alias("z"))
    a = scaled.select(F.col(group).alias("group_a"), F.col("z").alias("za"))
    b = scaled.select(F.col(group).alias("group_b"), F.col("z").alias("zb"))
    gap = F.zip_with("za", "zb", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    mean = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / len(columns)
    return a.join(b, F.col("group_a") != F.col("group_b")).select("group_a", "group_b", F.sqrt(mean).alias("shift"))


def histogram_bin(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Zero-based bin of equal width; the last bin includes its upper edge."""
    position = F.floor((value - low) / (high - low) * bins)
    return F.greatest(F.lit(0), F.least(bins - 1, position)).cast("long")


def banded(value: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """Word of the first band whose upper bound exceeds the value, else the last word."""
    return reduce(lambda acc, b: F.when(value < b[0], b[1]).otherwise(acc), reversed(bands), F.lit(last))
