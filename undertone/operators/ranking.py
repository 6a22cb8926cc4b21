"""Window and ranking operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.durable import Scratch


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; give the order enough keys to be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def average_rank_shares(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Percentile ranks in (0, 1] of several columns, ties at their average rank.

    ``(key, *columns)``, null where the value is null; ``key`` must be unique. All
    columns are ranked in one pass over the counts of their distinct values. The
    running sums go by range partitions of the values, so no task sorts a column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.select(F.col(key), F.inline(pairs)).where("_v is not null")
    share = running_total(long.groupBy("_c", "_v").agg(F.count("*").alias("_n")), ["_c"], "_v", "_n")
    share = share.select("_c", "_v", ((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_all")).alias("_share"))
    wide = long.join(share, ["_c", "_v"]).groupBy(key).agg(*[F.max(F.when(F.col("_c") == c, F.col("_share"))).alias(c) for c in columns])
    return df.select(key).join(wide, key, "left")


def running_total(df: DataFrame, group: list[str], order: str, amount: str) -> DataFrame:
    """Adds ``_below``, the amounts of a group's rows before in ``order``, and ``_all``, their sum.

    Rows are range-partitioned by group and order; each partition sums its own rows
    and adds the totals of the partitions before it, one number per partition. The
    ranges are drawn from a sample, so they are written once and read twice.
    """
    ranged = df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id())
    parts = Scratch(df.sparkSession, "running").save(ranged)
    within = Window.partitionBy(*group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("_own", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    totals = parts.groupBy(*group, "_part").agg(F.sum(amount).alias("_sum"))
    w = Window.partitionBy(*group)
    before = F.sum("_sum").over(w.orderBy("_part")) - F.col("_sum")
    offsets = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_sum").over(w).alias("_all"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)], F.col("_part") == F.col("_p"))
    return own.join(offsets, same).withColumn("_below", F.col("_own") + F.col("_before")).drop("_part", "_p", "_own", "_before", *[f"_k{i}" for i in range(len(group))])


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], out: str = "p") -> DataFrame:
    """Exact interpolated quantiles of each group as an array ``out``; null and NaN values do not count.

    They are read off the running counts of distinct values, so no task and no
    buffer holds a column, however few the groups.
    """
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("_v"))
    c = running_total(ok.groupBy(*group, "_v").agg(F.count("*").alias("_n")), group, "_v", "_n")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_v")))

    picks = []
    for i, q in enumerate(shares):
        place = (F.col("_all") - 1) * q
        picks += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    rows = c.groupBy(*group).agg(*picks)
    return rows.select(*group, F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}") for i in range(len(shares))]).alias(out))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their rank; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
