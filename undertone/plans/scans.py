"""Scans, upserts and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.plans.base import FEATS_SQL, FEATURES, feats
from undertone.plans.registry import query
from undertone.sources import landing
from undertone.tables import table


@query(f"with {FEATS_SQL} select id, {', '.join(FEATURES)}, estimated_mode from feats")
def features_latest(spark: SparkSession, root: str) -> DataFrame:
    """Newest extraction of every track with its named JSON numbers."""
    return feats(spark, root).select("id", *FEATURES, "estimated_mode")


@query(
    """select spotify_track_id, track_name, popularity, null as isrc from track_meta where album_type = 'single' union all by name select spotify_track_id, track_name, isrc from track_meta where album_type = 'album'"""
)
def union_mixed(spark: SparkSession, root: str) -> DataFrame:
    """Two shapes of one table united by name, missing columns null."""
    meta = table(spark, root, "track_meta")
    a = meta.where("album_type = 'single'").select("spotify_track_id", "track_name", "popularity")
    return landing.union_by_name([a, meta.where("album_type = 'album'").select("spotify_track_id", "track_name", "isrc")])


@query(
    """with r as (select spotify_track_id, tempo_bpm, rms_mean, extraction_source, extracted_at, extracted_at >= timestamp '2025-10-01' as fresh from track_features)
  select spotify_track_id, tempo_bpm, rms_mean, extraction_source, extracted_at from r where spotify_track_id is not null
  qualify row_number() over (partition by spotify_track_id order by coalesce(fresh, false) desc, extracted_at desc nulls last, tempo_bpm desc nulls last, rms_mean desc nulls last, extraction_source desc nulls last) = 1"""
)
def upsert_features(spark: SparkSession, root: str) -> DataFrame:
    """A newer batch replaces the rows of its keys; of several rows of a key the last one is kept whole."""
    cut = F.lit("2025-10-01").cast("timestamp_ntz")
    cols = ["spotify_track_id", "tempo_bpm", "rms_mean", "extraction_source", "extracted_at"]
    rows = table(spark, root, "track_features").where("spotify_track_id is not null").select(*cols)
    fresh = F.coalesce(F.col("extracted_at") >= cut, F.lit(False))
    order = [F.desc_nulls_last(c) for c in ("extracted_at", "tempo_bpm", "rms_mean", "extraction_source")]
    return landing.upsert(rows.where(~fresh), rows.where(fresh), "spotify_track_id", order)


@query(
    """select artist_id, arg_max(artist_name, (updated_at, artist_name)) filter (where trim(artist_name) <> '') as artist_name, arg_max(image_url, (updated_at, image_url)) filter (where trim(image_url) <> '') as image_url,
  arg_max(followers, (updated_at, followers)) filter (where followers is not null) as followers from artist_meta where artist_id is not null group by 1"""
)
def artist_last_known(spark: SparkSession, root: str) -> DataFrame:
    """Newest present value of every artist column."""
    rows = table(spark, root, "artist_meta").where("artist_id is not null")
    pick = [F.max_by(c, F.when(landing.present(c, t).isNotNull() & F.col("updated_at").isNotNull(), F.struct("updated_at", c))).alias(c) for c, t in (("artist_name", True), ("image_url", True), ("followers", False))]
    return rows.groupBy("artist_id").agg(*pick)


@query("select spotify_track_id as id, arg_max(extraction_source, (extracted_at, extraction_source)) as source, count(*) as n_events from track_features where spotify_track_id is not null and extracted_at is not null group by 1")
def provenance_latest(spark: SparkSession, root: str) -> DataFrame:
    """Current source of every track from an append-only log."""
    rows = table(spark, root, "track_features").where("spotify_track_id is not null and extracted_at is not null")
    return rows.groupBy(F.col("spotify_track_id").alias("id")).agg(F.max_by("extraction_source", F.struct("extracted_at", "extraction_source")).alias("source"), F.count("*").alias("n_events"))


@query("select spotify_track_id as id, landed_at > computed_at + interval 1 hour as late, count(*) as n from track_perceptual group by 1, 2")
def late_landings(spark: SparkSession, root: str) -> DataFrame:
    late = F.col("landed_at") > F.col("computed_at") + F.expr("interval 1 hour")
    return table(spark, root, "track_perceptual").groupBy(F.col("spotify_track_id").alias("id"), late.alias("late")).agg(F.count("*").alias("n"))
