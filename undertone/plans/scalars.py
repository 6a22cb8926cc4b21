"""Filters, scalar functions, sorting, paging and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.functions.vectors import norm
from undertone.plans.base import FEATS_SQL, PERC_SQL, feats, perc
from undertone.plans.joins import ARTIST_SQL, YEAR_SQL, artists, year_of
from undertone.plans.registry import query
from undertone.tables import table


@query(
    f"""select spotify_track_id as id, {YEAR_SQL} as year, case when regexp_matches(album_release_date, '^[0-9]{{4}}(-[0-9]{{2}}){{0,2}}$') then
  date_diff('day', try_cast(case length(album_release_date) when 4 then album_release_date || '-01-01' when 7 then album_release_date || '-01' else album_release_date end as date), date '2026-01-01') end as age_days from track_meta"""
)
def release_age(spark: SparkSession, root: str) -> DataFrame:
    """Year and age in days of dates of any precision, counted to a fixed day."""
    d = F.col("album_release_date")
    whole = d.rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$")
    padded = F.when(F.length(d) == 4, F.concat(d, F.lit("-01-01"))).when(F.length(d) == 7, F.concat(d, F.lit("-01"))).otherwise(d)
    day = F.when(whole, F.try_to_date(padded, "yyyy-MM-dd"))
    return table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), year_of("album_release_date").alias("year"), F.datediff(F.lit("2026-01-01").cast("date"), day).cast("long").alias("age_days"))


@query(
    f"""with {FEATS_SQL}, d as (select m.spotify_track_id as id, m.duration_ms / 1000.0 as e, f.duration_sec as a from track_meta m join feats f on f.id = m.spotify_track_id)
  select id, case when a is null or a <= 0 then false when e is null or e <= 0 then a > 1800 else a > greatest(2 * e, e + 120) end as implausible,
  case when a is null or e is null then true else abs(a - e) > greatest(20, 0.15 * e) end as mismatch from d"""
)
def duration_checks(spark: SparkSession, root: str) -> DataFrame:
    """Measured against catalogue duration, one- and two-sided."""
    a, e = F.col("duration_sec"), F.col("duration_ms") / 1000.0
    m = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), "duration_ms")
    far = F.when(a.isNull() | (a <= 0), False).when(e.isNull() | (e <= 0), a > 1800).otherwise(a > F.greatest(2 * e, e + 120))
    return m.join(feats(spark, root).select("id", "duration_sec"), "id").select("id", far.alias("implausible"), F.when(a.isNull() | e.isNull(), True).otherwise(F.abs(a - e) > F.greatest(F.lit(20.0), 0.15 * e)).alias("mismatch"))


@query(
    f"""with {PERC_SQL}, st as (select stddev_pop(energy) as se, stddev_pop(danceability) as sd from perc) select id, round(sqrt((power((energy - 0.7) / se, 2) + power((danceability - 0.6) / sd, 2)) / 2), 4) as score
  from perc, st where energy >= 0.4 and acousticness <= 0.6 and danceability is not null order by 2, 1 limit 20"""
)
def recommend(spark: SparkSession, root: str) -> DataFrame:
    """Rows within bounds, ordered by their RMS distance to the targets in population spreads."""
    p = perc(spark, root)
    st = p.agg(F.stddev_pop("energy").alias("se"), F.stddev_pop("danceability").alias("sd"))
    ok = p.where("energy >= 0.4 and acousticness <= 0.6 and danceability is not null").join(F.broadcast(st), F.lit(True))
    gap = F.pow((F.col("energy") - 0.7) / F.col("se"), 2) + F.pow((F.col("danceability") - 0.6) / F.col("sd"), 2)
    return ok.select("id", F.round(F.sqrt(gap / 2), 4).alias("score")).orderBy("score", "id").limit(20)


@query("select spotify_track_id as id from track_meta where contains(lower(coalesce(track_name, '')), 'river') or contains(lower(coalesce(artist_names, '')), 'river')")
def catalogue_search(spark: SparkSession, root: str) -> DataFrame:
    hit = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("river")) for c in ("track_name", "artist_names")]
    return table(spark, root, "track_meta").where(hit[0] | hit[1]).select(F.col("spotify_track_id").alias("id"))


@query(f"with {ARTIST_SQL} select artist_id from artists where list_contains(list_transform(string_split(genres, ','), lambda x: lower(trim(x))), 'folk')")
def genre_filter(spark: SparkSession, root: str) -> DataFrame:
    return artists(spark, root).where(F.array_contains(F.transform(F.split("genres", ","), lambda x: F.lower(F.trim(x))), "folk")).select("artist_id")


@query(
    "select user_id, arg_max(event_type, (ts, event_id)) as state, count(*) as n_events, count(*) filter (where event_type = 'error') as attempts, count(*) filter (where event_type = 'error') >= 3 as dead from events group by 1"
)
def queue_state(spark: SparkSession, root: str) -> DataFrame:
    """Current state of every key of an event log; three failures make a dead letter."""
    bad = F.count_if(F.col("event_type") == "error")
    return table(spark, root, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"), bad.alias("attempts"), (bad >= 3).alias("dead"))


@query("select event_type, count(*) as n, count(*) filter (where value > 50) as n_high, cast(date_trunc('day', ts) as varchar)[1:10] as day from events group by event_type, date_trunc('day', ts)")
def daily_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


@query(
    """with g as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events), s as (select *, sum(case when before is null or ts - before > interval 6 hour then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from g)
  select user_id, cast(session as bigint) as session, count(*) as n, round(sum(value), 4) as total from s group by 1, 2"""
)
def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Gap-based sessions of every user: gaps of more than six hours start a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours")
    s = table(spark, root, "events").withColumn("start", F.when(F.lag("ts").over(w).isNull() | gap, 1).otherwise(0)).withColumn("session", F.sum("start").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select spotify_track_id as id, popularity from track_meta order by popularity desc nulls last, lower(coalesce(track_name, '')), spotify_track_id limit 100 offset 100")
def library_page(spark: SparkSession, root: str) -> DataFrame:
    """Second page of 100 after a directional sort with nulls last."""
    rows = table(spark, root, "track_meta").orderBy(F.desc_nulls_last("popularity"), F.lower(F.coalesce("track_name", F.lit(""))), "spotify_track_id")
    return rows.offset(100).limit(100).select(F.col("spotify_track_id").alias("id"), "popularity")


@query(
    "with s as (select doc_id, coalesce(source, '') as source, row_number() over (partition by source order by doc_id) as k from documents) select source, doc_id from s where k <= 5"
)
def stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    """The first five documents of every source."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, root, "documents").withColumn("k", F.row_number().over(w)).where("k <= 5").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id")


@query("select vec_id, len(embedding) as dims, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 5) as length from embeddings")
def embedding_norms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(norm(F.col("embedding")), 5).alias("length"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    """select spotify_track_id as id, coalesce(track_name, 'unknown') as track_name, coalesce(artist_names, 'unknown') as artist_names, coalesce(popularity, 0) as popularity, coalesce(duration_ms, 0) as duration_ms, coalesce(album_type, 'unknown') as album_type from track_meta"""
)
def cleansed_tracks(spark: SparkSession, root: str) -> DataFrame:
    """Typed catalogue rows with nulls filled."""
    from undertone.sources.cleansing import fill

    rows = fill(table(spark, root, "track_meta"), {"track_name": "string", "artist_names": "string", "popularity": "int", "duration_ms": "bigint", "album_type": "string"})
    return rows.select(F.col("spotify_track_id").alias("id"), "track_name", "artist_names", "popularity", "duration_ms", "album_type")


@query(f"with {FEATS_SQL} select id, cast(coalesce(tempo_bpm, 0) as float) as tempo_bpm, cast(coalesce(rms_mean, 0) as float) as rms_mean, cast(coalesce(estimated_key, 0) as bigint) as estimated_key, coalesce(estimated_mode, 'unknown') as estimated_mode from feats")
def cleansed_features(spark: SparkSession, root: str) -> DataFrame:
    from undertone.sources.cleansing import fill

    rows = feats(spark, root).select("id", "tempo_bpm", "rms_mean", "estimated_key", "estimated_mode")
    return fill(rows, {"tempo_bpm": "float", "rms_mean": "float", "estimated_key": "bigint", "estimated_mode": "string"})


@query(f"with {FEATS_SQL} select id, case when lower(estimated_mode) like 'maj%' then 1.0 when estimated_mode is not null then 0.0 end as mode_number from feats")
def mode_numbers(spark: SparkSession, root: str) -> DataFrame:
    m = F.col("estimated_mode")
    return feats(spark, root).select("id", F.when(F.lower(m).startswith("maj"), 1.0).when(m.isNotNull(), 0.0).alias("mode_number"))


@query(
    """with t as (select track_id as id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda x: x <> '' and x not in ('the', 'a', 'of', 'for')))) as w from (select distinct track_id, title from dedup_records)),
  m as (select spotify_track_id as id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(track_name, '')), '[^a-z0-9]+'), lambda x: x <> '' and x not in ('the', 'a', 'of', 'for'))) as w from track_meta)
  select t.id, len(list_intersect(t.w, m.w)) as common, case when len(m.w) = 0 then 0.0 else round(len(list_intersect(t.w, m.w)) / len(m.w), 6) end as recall from t join m using (id)"""
)
def title_recall(spark: SparkSession, root: str) -> DataFrame:
    """Share of catalogue title words that a candidate's title contains."""
    def tokens(col):
        ws = F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+")
        return F.array_distinct(F.filter(ws, lambda x: (x != "") & ~x.isin("the", "a", "of", "for")))

    t = table(spark, root, "dedup_records").select(F.col("track_id").alias("id"), "title").distinct().select("id", tokens(F.col("title")).alias("t"))
    m = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), tokens(F.col("track_name")).alias("m"))
    common = F.size(F.array_intersect("t", "m"))
    return t.join(m, "id").select("id", common.cast("long").alias("common"), F.when(F.size("m") == 0, 0.0).otherwise(F.round(common / F.size("m"), 6)).alias("recall"))


@query("""select (select count(*) from track_meta where spotify_track_id is null) as null_ids, (select count(*) from (select spotify_track_id from track_meta group by 1 having count(*) > 1)) as repeated_ids,
  (select count(*) from track_meta where duration_ms <= 0 or duration_ms > 5400000) as odd_durations, (select count(*) from track_features where match_confidence not between 0 and 1) as odd_confidence""")
def quality_sweep(spark: SparkSession, root: str) -> DataFrame:
    """One count per invariant."""
    meta = table(spark, root, "track_meta")
    one = meta.agg(F.count_if(F.col("spotify_track_id").isNull()).alias("null_ids"), F.count_if((F.col("duration_ms") <= 0) | (F.col("duration_ms") > 5400000)).alias("odd_durations"))
    two = meta.groupBy("spotify_track_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    three = table(spark, root, "track_features").agg(F.count_if(~F.col("match_confidence").between(0, 1)).alias("odd_confidence"))
    return one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(three), F.lit(True)).select("null_ids", "repeated_ids", "odd_durations", "odd_confidence")


@query(
    """with a as (select distinct artist_id from documents where lang = 'en' and artist_id is not null), b as (select distinct artist_id from documents where lang = 'de' and artist_id is not null)
  select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'only_en', count(*) from (select * from a except select * from b) union all select 'either', count(*) from (select * from a union select * from b)"""
)
def artist_sets(spark: SparkSession, root: str) -> DataFrame:
    """Overlap, difference and union of the artists written about in two languages."""
    docs = table(spark, root, "documents").where("artist_id is not null and lang in ('en', 'de')")
    by = docs.groupBy("artist_id").agg(F.max(F.col("lang") == "en").alias("en"), F.max(F.col("lang") == "de").alias("de"))
    one = by.agg(F.count_if(F.col("en") & F.col("de")).alias("both"), F.count_if(F.col("en") & ~F.col("de")).alias("only_en"), F.count("*").alias("either"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("n")) for c in ("both", "only_en", "either")])))
