"""Streams and models over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.durable import Scratch
from undertone.operators import models
from undertone.plans.base import FEATS_SQL, SIMILARITY, feats, is_seed, perc
from undertone.plans.registry import query
from undertone.streaming.events import drain, read_events, windowed_counts
from undertone.tables import table

_DIMS = ["tempo", "energy", "danceability", "acousticness", "brightness", "dynamics"]


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily(spark: SparkSession, root: str) -> DataFrame:
    """Daily counts by a stream with a watermark, drained to its end."""
    rows = drain(windowed_counts(read_events(spark, root)), "stream")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def _complete(spark: SparkSession, root: str) -> DataFrame:
    rows = feats(spark, root).dropna(subset=SIMILARITY).where("tempo_bpm > 1")
    st = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in SIMILARITY], *[F.stddev_pop(c).alias(f"s_{c}") for c in SIMILARITY])
    z = [(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in SIMILARITY]
    return rows.join(F.broadcast(st), F.lit(True)).select("id", F.array(*z).alias("v"))


@query()
def cluster_model(spark: SparkSession, root: str) -> DataFrame:
    """Cluster and map coordinates of every complete track; k from 3 to 9 by silhouette."""
    rows = _complete(spark, root)
    assigned, k, score = models.fit_clusters(rows, "v", range(3, 10))
    return models.project(assigned, "v").select("id", "cluster_id", F.round("map_x", 4).alias("map_x"), F.round("map_y", 4).alias("map_y"), F.lit(k).alias("k"), F.lit(round(score, 4)).alias("silhouette"))


@query()
def whitened_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Ten nearest tracks of every 50th track in whitened space, exactly."""
    rows = _complete(spark, root)
    w = models.whitening_matrix(rows, "v", len(SIMILARITY))
    rows = models.apply_matrix(rows, "v", w, "u") if w is not None else rows.withColumn("u", F.col("v"))
    rows = Scratch(spark, "whitened").save(rows.select("id", "u"))
    return models.nearest_k(rows, "id", "u", rows.where(is_seed("id")), 10).select("seed", "item", "rank", F.round("distance", 5).alias("distance"))


@query()
def popularity_model(spark: SparkSession, root: str) -> DataFrame:
    """Error of a forest that guesses popularity from perceptual columns."""
    meta = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), "popularity", F.col("duration_ms").cast("double").alias("duration_ms"))
    rows = perc(spark, root).where("abs(tempo) < 1e6").select("id", *_DIMS).join(meta, "id")
    mae, r2, n = models.popularity_forest(rows, "popularity", [*_DIMS, "duration_ms"])
    return spark.createDataFrame([(round(mae, 4), round(r2, 4), n)], "mae double, r2 double, n long")


# Words of the columns that name a cluster.
WORDS = {
    "rms_mean": ("Loud", "Quiet"), "tempo_bpm": ("Fast", "Slow"), "harmonic_ratio": ("Harmonic", "Percussive"), "spectral_centroid_mean": ("Bright", "Dark"),
    "zcr_mean": ("Noisy", "Smooth"), "onset_strength_mean": ("Punchy", "Gentle"),
}


@query(
    f"""with {FEATS_SQL}, mx as (select max(model_id) as m from track_clusters), lab as (select spotify_track_id as id, min(cluster_id) as cluster_id from track_clusters, mx where model_id = m and cluster_id is not null group by 1),
  f as (select * from feats join lab using (id)), st as (select {", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in WORDS)} from f), g as (select cluster_id, {", ".join(f"avg({c}) as {c}" for c in WORDS)} from f group by 1),
  l as ({" union all ".join(f"select cluster_id, round(abs(({c} - m_{c}) / s_{c}), 9) as z, case when {c} > m_{c} then '{hi}' else '{lo}' end as word from g, st where s_{c} > 0 and {c} is not null" for c, (hi, lo) in WORDS.items())}),
  k as (select *, row_number() over (partition by cluster_id order by z desc, word desc) as k from l), n as (select cluster_id, string_agg(word, ' · ' order by k) as label from k where k <= 2 group by 1)
  select g.cluster_id, coalesce(n.label, 'Mixed') as label from g left join n using (cluster_id)"""
)
def cluster_labels(spark: SparkSession, root: str) -> DataFrame:
    """Words for the clusters of the newest model."""
    clusters = table(spark, root, "track_clusters").where("cluster_id is not null")
    newest = table(spark, root, "track_clusters").agg(F.max("model_id").alias("m"))
    lab = clusters.join(F.broadcast(newest), F.col("model_id") == F.col("m")).groupBy(F.col("spotify_track_id").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    return models.label_clusters(feats(spark, root).select("id", *WORDS).join(lab, "id"), "cluster_id", WORDS)
