"""Judging similarity and clusters: intervals, negatives, null models and matching of cluster identities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertone.operators.ranking import running_total


def bootstrap_interval(df: DataFrame, key: str, value: str, rounds: int = 500, alpha: float = 0.05, seed: int = 7) -> tuple[float, float] | None:
    """Percentile interval of the mean by Poisson resampling: every row gets its weights where it lies.

    Weights follow from the hash of the unique ``key``, so the result does not
    depend on the partitions. One row per round leaves the tasks; no values give
    None.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(key).alias("i"))
    rounds_of = rows.select("v", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"), "i")
    u = F.pmod(F.xxhash64("r", "i", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cuts, acc, p = [], 0.0, float(np.exp(-1))
    for k in range(8):
        acc += p
        cuts.append(acc)
        p /= k + 1
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    means = rounds_of.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).where("m is not null")
    got = np.array([r["m"] for r in means.collect()])
    return (float(np.quantile(got, alpha / 2)), float(np.quantile(got, 1 - alpha / 2))) if len(got) else None


def negatives(seeds: DataFrame, items: DataFrame, truth: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """``k`` items per seed that are no partners, drawn by hash from ``(seed)``, ``(item)``, ``(seed, item)``.

    Items stand on a ring by hash; each seed takes the ones that follow its own
    ``k`` places, so nothing is crossed. Partners and the seed itself are skipped,
    which can leave fewer than ``k``.
    """
    ring = running_total(items.select("item").distinct().withColumn("h", F.xxhash64("item", F.lit(seed))).withColumn("g", F.lit(0)).withColumn("one", F.lit(1)), ["g"], "h", "one")
    ring = ring.select("item", F.col("_below").alias("place"), F.col("_all").alias("n"))
    n = ring.agg(F.max("n").alias("n"))
    asked = seeds.select("seed").distinct().join(F.broadcast(n), F.lit(True)).select("seed", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"), "n")
    asked = asked.select("seed", F.pmod(F.xxhash64("seed", "j", F.lit(seed)), F.col("n")).alias("place"))
    drawn = asked.join(ring.select("place", "item"), "place").where("seed <> item").select("seed", "item").distinct()
    return drawn.join(truth.select("seed", "item").distinct(), ["seed", "item"], "left_anti")


def shuffled_columns(df: DataFrame, ident: str, columns: list[str], seed: int) -> DataFrame:
    """The null model: every column shuffled on its own, so that spreads stay and ties between columns go."""
    numbered = None
    for i, c in enumerate(columns):
        keyed = df.select(F.col(ident).alias("_id"), F.col(c).alias(c), F.xxhash64(ident, F.lit(seed), F.lit(i + 1)).alias("_h"), F.lit(0).alias("_g"), F.lit(1).alias("_one"))
        placed = running_total(keyed, ["_g"], "_h", "_one").select(F.col("_below").alias("_place"), c)
        numbered = placed if numbered is None else numbered.join(placed, "_place")
    ids = df.select(F.col(ident), F.xxhash64(ident, F.lit(seed), F.lit(0)).alias("_h"), F.lit(0).alias("_g"), F.lit(1).alias("_one"))
    ids = running_total(ids, ["_g"], "_h", "_one").select(ident, F.col("_below").alias("_place"))
    return ids.join(numbered, "_place").drop("_place")


def p_value(observed: float, null: list[float]) -> float:
    """Share of null models that are at least as good, the observed one counted."""
    return (sum(v >= observed for v in null) + 1) / (len(null) + 1)


def match_identity(old: dict[int, tuple[str, list[float]]], new: dict[int, tuple[str, list[float]]], least: float = 0.90) -> dict[int, int] | None:
    """New clusters to old ones, greedily by cosine of their centroids, or None unless all match one to one under equal labels.

    Centroids are one per cluster of a model, a handful.
    """
    if len(old) != len(new):
        return None
    a, b = list(old), list(new)
    x, y = np.array([old[i][1] for i in a], float), np.array([new[j][1] for j in b], float)
    unit = [v / np.where((s := np.linalg.norm(v, axis=1, keepdims=True)) > 0, s, 1) for v in (x, y)]
    close = unit[0] @ unit[1].T
    order = sorted(((-close[i, j], a[i], b[j]) for i in range(len(a)) for j in range(len(b))))
    got: dict[int, int] = {}
    for minus, i, j in order:
        if -minus >= least and j not in got and i not in got.values() and old[i][0] == new[j][0]:
            got[j] = i
    return got if len(got) == len(new) else None


def first_mentions(df: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """Items of each group in order of their first occurrence: ``(group, items)``."""
    first = df.groupBy(group, item).agg(F.min(order).alias("_o"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", item))), lambda x: x[item]).alias("items"))


def enumerate_rows(df: DataFrame, group: str, order: list) -> DataFrame:
    """Rank from 1 in the order of a response."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
