"""Consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from undertone.durable import Scratch
from undertone.skew import HOT_ROWS, hot_keys, split_join


def hash_to_min(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for each vertex on an edge; component is its smallest vertex.

    The cluster set of a vertex is kept as rows ``(v, u)``, never as one array.
    In each round the smallest member m of every set is found; the set goes to m
    as rows ``(m, u)`` and m to every member as rows ``(u, m)``; repeated rows
    fold. When a round leaves the rows as they were, m's set is its component.
    Edges with a null side are ignored; self-edges and repeats change nothing;
    no edges give an empty result. The rounds are O(log n) for paths. A vertex
    whose set holds a large part of all rows is joined by a bounded broadcast
    (see ``skew``), so its rows never gather in one task.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    both = F.array(F.struct(F.col("x").alias("v"), F.col("y").alias("u")), F.struct(F.col("y").alias("v"), F.col("x").alias("u")), F.struct(F.col("x").alias("v"), F.col("x").alias("u")), F.struct(F.col("y").alias("v"), F.col("y").alias("u")))
    rows, state = _saved(scratch, e.select(F.inline(both)).distinct())
    for _ in range(max_rounds):
        seen = Observation()
        low = scratch.save(rows.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).observe(seen, F.max("n").alias("top")))
        hot = hot_keys(low, "v", "n", state[0]) if (seen.get["top"] or 0) > HOT_ROWS else []
        sent = split_join(rows, low.select("v", "m"), "v", hot)
        spread = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        fresh, now = _saved(scratch, sent.select(F.inline(spread)).distinct())
        scratch.drop(low)
        scratch.drop(rows)
        rows, was, state = fresh, state, now
        if was == state:
            break
    else:
        raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")
    return rows.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "vertex")


def _saved(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, tuple]:
    """Write the rows; with them their number and an order-free fingerprint."""
    seen = Observation()
    out = scratch.save(rows.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")))
    return out, (seen.get["n"], seen.get["x"])
