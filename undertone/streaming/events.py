"""Event streams: windowed counts with late data, and landing batches that keep the newest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.durable import Scratch
from undertone.operators.ranking import keep_latest


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts per event type and tumbling window; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there and return the final state of its aggregate."""
    spark = stream.sparkSession
    scratch = Scratch(spark, label)
    target = f"{scratch.root}/state"
    job = (
        stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{scratch.root}/progress")
        .foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(target)).start()
    )
    job.awaitTermination()
    return spark.read.parquet(target)


def land_latest(stream: DataFrame, target: str, progress: str, key: str, order: str):
    """Keep the newest row per key of a landing stream in a table: each batch is folded into the next version.

    Versions alternate between two folders, so a reader never meets a half-written table.
    """

    def fold(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        merged = rows
        if batch:
            merged = spark.read.parquet(f"{target}/v{(batch - 1) % 2}").unionByName(rows, allowMissingColumns=True)
        keep_latest(merged, [key], [F.desc_nulls_last(order), F.xxhash64(*merged.columns)]).write.mode("overwrite").parquet(f"{target}/v{batch % 2}")

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", progress).foreachBatch(fold).start()
