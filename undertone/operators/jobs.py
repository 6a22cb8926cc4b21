"""A work queue as a table: every operation takes the jobs and returns the jobs that replace them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.operators.ranking import keep_latest

#: Failures after which a job is no longer tried.
MAX_ATTEMPTS = 3
SCHEMA = "id string, status string, requested_at timestamp_ntz, attempts int, reason string"


def in_order() -> list[Column]:
    """Running jobs first, then by age."""
    return [F.col("status") != "running", F.col("requested_at"), F.col("id")]


def enqueue(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Adds the ids that have no job; failed jobs that may be tried again are queued anew."""
    fresh = ids.select("id").where("id is not null").distinct().join(jobs.select("id"), "id", "left_anti")
    added = fresh.select("id", F.lit("queued").alias("status"), now.cast("timestamp_ntz").alias("requested_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("reason"))
    asked = jobs.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    again = F.col("_asked") & (F.col("status") == "failed") & (F.col("attempts") < MAX_ATTEMPTS)
    kept = asked.select("id", F.when(again, "queued").otherwise(F.col("status")).alias("status"), "requested_at", "attempts", "reason")
    return kept.unionByName(added)


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The jobs with the oldest ``n`` queued ones running."""
    oldest = jobs.where("status = 'queued'").orderBy("requested_at", "id").limit(n).select("id", F.lit(True).alias("_claimed"))
    return jobs.join(F.broadcast(oldest), "id", "left").withColumn("status", F.when(F.col("_claimed"), "running").otherwise(F.col("status"))).drop("_claimed")


def settle(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Running jobs with their outcome ``(id, ok, reason)``: done, or failed with one more attempt."""
    last = keep_latest(outcomes.select("id", "ok", F.col("reason").alias("_why")), ["id"], [F.desc("ok"), F.col("_why")])
    rows = jobs.join(last, "id", "left")
    over = (F.col("status") == "running") & F.col("ok").isNotNull()
    return rows.select(
        "id", F.when(over, F.when(F.col("ok"), "done").otherwise("failed")).otherwise(F.col("status")).alias("status"), "requested_at",
        (F.col("attempts") + F.when(over & ~F.col("ok"), 1).otherwise(0)).alias("attempts"), F.when(over & ~F.col("ok"), F.substring("_why", 1, 500)).otherwise(F.col("reason")).alias("reason"),
    )


def requeue_stale(jobs: DataFrame, before: Column) -> DataFrame:
    """Running jobs asked for before a time go back to the queue, as their worker is gone."""
    return jobs.withColumn("status", F.when((F.col("status") == "running") & (F.col("requested_at") < before), "queued").otherwise(F.col("status")))


def state_of(analyzed: Column, status: Column, attempts: Column) -> Column:
    """What a library row shows: nothing once analysed, else where its job stands."""
    return F.when(analyzed, None).when(status.isin("queued", "running"), "analyzing").when((status == "failed") & (attempts >= MAX_ATTEMPTS), "no_source").when(status == "failed", "retry_pending")


def quarantine(planes: dict[str, tuple[DataFrame, str]], jobs: DataFrame, reasons: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Takes ids out of every derived table and marks their jobs as dead: ``(tables, jobs)``.

    ``planes`` gives each table with its id column, ``reasons`` has ``(id, reason)``.
    """
    bad = keep_latest(reasons.where("id is not null").select("id", F.substring("reason", 1, 500).alias("_why")), ["id"], [F.col("_why")])
    left = {name: df.join(bad.select(F.col("id").alias(key)), key, "left_anti") for name, (df, key) in planes.items()}
    marked = jobs.join(bad, "id", "left")
    hit = F.col("_why").isNotNull()
    dead = marked.select("id", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), "requested_at", F.when(hit, MAX_ATTEMPTS).otherwise(F.col("attempts")).alias("attempts"), F.when(hit, F.col("_why")).otherwise(F.col("reason")).alias("reason"))
    return left, dead
