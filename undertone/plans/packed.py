"""Packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.operators.packed import split_packed
from undertone.plans.registry import query
from undertone.tables import table


@query()
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Values of ``artist_names`` and ``genres`` fields that hold two or more."""
    artists = table(spark, root, "artist_meta")
    names = split_packed(table(spark, root, "track_meta"), "spotify_track_id", "artist_names", artists.select("artist_name"), "artist_name")
    genres = split_packed(artists, "artist_id", "genres", table(spark, root, "genre_terms"), "genre")
    parts = names.withColumn("source_table", F.lit("track_meta")).unionByName(genres.withColumn("source_table", F.lit("artist_meta")))
    return parts.where("n_items >= 2").select("source_table", "record_id", "pos", "item")
