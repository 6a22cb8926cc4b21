"""Frames that several plans share, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.functions.numbers import number
from undertone.operators.ranking import keep_latest, running_total
from undertone.tables import table

# Feature names of the catalogue.
SIMILARITY = [
    "tempo_bpm", "rms_mean", "zcr_mean", "spectral_centroid_mean", "spectral_rolloff_mean", "spectral_bandwidth_mean", "harmonic_ratio",
    "onset_strength_mean", "mfcc_mean_0", "mfcc_mean_1", "mfcc_mean_2", "mfcc_mean_3", "mfcc_mean_4",
]
FEATURES = [*SIMILARITY, "onset_strength_std", "beats_per_sec", "duration_sec", "estimated_key"]
#: Columns of the axes that an extraction may lack altogether.
EXTRA = ["spectral_flatness_mean", "rms_std"]
PERCEPTUAL = ["tempo", "key", "mode", "duration_sec", "loudness_db", "time_signature", "energy", "danceability", "acousticness", "speechiness", "brightness", "punch", "dynamics", "valence_proxy"]
WINDOWS = [("short_term", 28, 1), ("medium_term", 180, 2), ("long_term", 1095, 3)]

_NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _json_number(key: str, col: str = "features") -> str:
    text = f"trim(json_extract_string({col}, '$.{key}'))"
    return f"case when json_valid({col}) and regexp_matches({text}, '{_NUM}') and isfinite(try_cast({text} as double)) then try_cast({text} as double) end as {key}"


FEATS_SQL = f"""feats as (
  select spotify_track_id as id, {", ".join(_json_number(c) for c in [*FEATURES, *EXTRA])},
    case when json_valid(features) then json_extract_string(features, '$.estimated_mode') end as estimated_mode,
    dsp_version, extraction_source, match_confidence, extracted_at
  from (select * from track_features where spotify_track_id is not null
    qualify row_number() over (partition by spotify_track_id order by extracted_at desc nulls last, features desc nulls last) = 1))"""

PERC_SQL = f"""perc as (
  select spotify_track_id as id, {", ".join(_json_number(c) for c in PERCEPTUAL)}, version, computed_at
  from (select * from track_perceptual where spotify_track_id is not null
    qualify row_number() over (partition by spotify_track_id order by computed_at desc nulls last, landed_at desc nulls last, version desc nulls last, features desc nulls last) = 1))"""

LISTEN_SQL = """plays as (select spotify_track_id as id, artist_id, created_at, doc_id from documents where spotify_track_id is not null),
edge as (select max(created_at) as last from plays),
wins as (select * from (values ('short_term', 28, 1), ('medium_term', 180, 2), ('long_term', 1095, 3)) w(time_range, days, range_order)),
listen as (
  select time_range, range_order, id, count(*) as plays,
    row_number() over (partition by time_range order by count(*) desc, id) as rank
  from plays, edge, wins where created_at > last - to_days(cast(days as integer)) group by 1, 2, 3)"""

TWINS_SQL = """twins as (select spotify_track_id as id from track_meta where duplicate_of is not null and trim(duplicate_of) <> '' and duplicate_of <> spotify_track_id),
validated as (select distinct spotify_track_id as id from track_features where match_confidence >= 0.5 and spotify_track_id is not null),
analyzed as (select distinct spotify_track_id as id from track_features where spotify_track_id is not null),
excluded as (
  select id from twins
  union select id from analyzed where id not in (select id from validated) and (select count(*) from validated) > 0),
canonical as (select id from analyzed where id not in (select id from excluded))"""


#: Queries of a search: every 50th id by its MD5, which Spark and SQL agree on.
SEED_SQL = "('0x' || substr(md5(id), 1, 8))::bigint % 50 = 0"


def is_seed(ident: str):
    return F.conv(F.substring(F.md5(F.col(ident).cast("binary")), 1, 8), 16, 10).cast("long") % 50 == 0


def json_numbers(rows: DataFrame, numbers: list[str], texts: list[str], keep: list[str], col: str = "features") -> DataFrame:
    """Fields of a JSON object, numbers as doubles, from one parse of it, beside the columns ``keep``."""
    names = [*numbers, *texts]
    flat = rows.select(*keep, F.json_tuple(col, *names).alias(*[f"_{c}" for c in names]))
    return flat.select(*keep, *[number(F.col(f"_{c}")).alias(c) for c in numbers], *[F.col(f"_{c}").alias(c) for c in texts])


def feats(spark: SparkSession, root: str) -> DataFrame:
    """Newest extraction of every track, the named JSON numbers as columns."""
    latest = keep_latest(
        table(spark, root, "track_features").where("spotify_track_id is not null"), ["spotify_track_id"], [F.desc_nulls_last("extracted_at"), F.desc_nulls_last("features")]
    )
    keep = ["dsp_version", "extraction_source", "match_confidence", "extracted_at"]
    return json_numbers(latest.withColumnRenamed("spotify_track_id", "id"), [*FEATURES, *EXTRA], ["estimated_mode"], ["id", *keep])


def perc(spark: SparkSession, root: str) -> DataFrame:
    """Newest perceptual row of every track."""
    order = [F.desc_nulls_last(c) for c in ("computed_at", "landed_at", "version", "features")]
    latest = keep_latest(table(spark, root, "track_perceptual").where("spotify_track_id is not null"), ["spotify_track_id"], order)
    return json_numbers(latest.withColumnRenamed("spotify_track_id", "id"), PERCEPTUAL, [], ["id", "version", "computed_at"])


def windows(spark: SparkSession) -> DataFrame:
    """The three nominal listening windows."""
    return spark.createDataFrame(WINDOWS, "time_range string, days int, range_order int")


def ranked_listen(spark: SparkSession, root: str) -> DataFrame:
    """``listen`` with the rank of each track in its window, by range partitions of the plays."""
    rows = listen(spark, root).withColumn("place", F.struct((-F.col("plays")).alias("p"), "id")).withColumn("one", F.lit(1))
    return running_total(rows, ["time_range"], "place", "one").withColumn("rank", (F.col("_below") + 1).cast("long")).drop("place", "one", "_below", "_all")


def listen(spark: SparkSession, root: str) -> DataFrame:
    """Tracks per listening window with how often they are written about."""
    plays = table(spark, root, "documents").where("spotify_track_id is not null").select(F.col("spotify_track_id").alias("id"), "created_at")
    last = plays.agg(F.max("created_at").alias("last"))
    inside = F.array(*[F.when(F.col("created_at") > F.col("last") - F.expr(f"interval {d} days"), F.struct(F.lit(n).alias("time_range"), F.lit(o).alias("range_order"))) for n, d, o in WINDOWS])
    spread = plays.join(F.broadcast(last), F.lit(True)).select("id", F.inline(F.filter(inside, lambda w: w.isNotNull())))
    return spread.groupBy("time_range", "range_order", "id").agg(F.count("*").alias("plays"))


def twins(spark: SparkSession, root: str) -> DataFrame:
    """Tracks that are marked as duplicates of another."""
    return table(spark, root, "track_meta").where("duplicate_of is not null and trim(duplicate_of) <> '' and duplicate_of <> spotify_track_id").select(F.col("spotify_track_id").alias("id"))


def excluded(spark: SparkSession, root: str) -> DataFrame:
    """Twins, and analysed tracks without a validated source unless none is validated at all."""
    rows = table(spark, root, "track_features").where("spotify_track_id is not null").select(F.col("spotify_track_id").alias("id"), "match_confidence")
    state = rows.groupBy("id").agg(F.max(F.coalesce(F.col("match_confidence") >= 0.5, F.lit(False))).alias("ok"))
    some = state.agg(F.max("ok").alias("some"))
    bad = state.join(F.broadcast(some), F.lit(True)).where("some and not ok").select("id")
    return twins(spark, root).union(bad).distinct()


def canonical(spark: SparkSession, root: str) -> DataFrame:
    """Analysed tracks that count in aggregates."""
    analyzed = table(spark, root, "track_features").where("spotify_track_id is not null").select(F.col("spotify_track_id").alias("id")).distinct()
    return analyzed.join(excluded(spark, root), "id", "left_anti")
