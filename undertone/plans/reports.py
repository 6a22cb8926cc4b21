"""Queue, match, provenance and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.operators.ranking import running_total
from undertone.plans.base import LISTEN_SQL, TWINS_SQL, WINDOWS, canonical, listen, windows
from undertone.plans.joins import ARTIST_SQL, artists
from undertone.plans.registry import query
from undertone.tables import table

@query("select * from (values " + ", ".join(f"('{n}', {d}, {o})" for n, d, o in WINDOWS) + ") w(time_range, days, range_order)")
def time_windows(spark: SparkSession, root: str) -> DataFrame:
    """Dimension of the nominal windows."""
    return windows(spark)


@query("with c as (select popularity, count(*) as n from track_meta where popularity is not null group by 1) select popularity, round(100.0 * sum(n) over (order by popularity) / sum(n) over (), 6) as percentile from c")
def popularity_percentile(spark: SparkSession, root: str) -> DataFrame:
    """Share of tracks at or below every popularity; at most 101 values reach the window."""
    c = table(spark, root, "track_meta").where("popularity is not null").groupBy("popularity").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("popularity").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("popularity", F.round(100.0 * F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("percentile"))


@query(
    "with r as (select album_type, duration_ms, row_number() over (partition by album_type order by duration_ms) as k, count(*) over (partition by album_type) as n from track_meta where duration_ms is not null) select album_type, duration_ms as upper_median from r where k = n // 2 + 1"
)
def upper_median(spark: SparkSession, root: str) -> DataFrame:
    """The value at place n // 2 of each sorted group, from running counts of distinct values."""
    c = table(spark, root, "track_meta").where("duration_ms is not null").groupBy("album_type", "duration_ms").agg(F.count("*").alias("n"))
    upto = running_total(c, ["album_type"], "duration_ms", "n")
    place = F.floor(F.col("_all") / 2)
    return upto.where((F.col("_below") <= place) & (place < F.col("_below") + F.col("n"))).select("album_type", F.col("duration_ms").alias("upper_median"))


@query(
    f"""with {TWINS_SQL}, mx as (select max(model_id) as m from track_clusters), got as (select distinct spotify_track_id as id from track_clusters, mx where model_id = m and cluster_id is not null),
  n as (select (select count(*) from canonical) as population, (select count(*) from canonical where id in (select id from got where id is not null)) as assigned)
  select population, assigned, round(assigned / population, 6) as coverage, assigned / population < 0.95 as stale from n"""
)
def model_freshness(spark: SparkSession, root: str) -> DataFrame:
    """Whether the newest model covers the population."""
    clusters = table(spark, root, "track_clusters")
    newest = clusters.agg(F.max("model_id").alias("m"))
    got = clusters.where("cluster_id is not null").join(F.broadcast(newest), F.col("model_id") == F.col("m")).select(F.col("spotify_track_id").alias("id")).distinct().withColumn("got", F.lit(True))
    n = canonical(spark, root).join(got, "id", "left").agg(F.count("*").alias("population"), F.count("got").alias("assigned"))
    share = F.col("assigned") / F.col("population")
    return n.select("population", "assigned", F.round(share, 6).alias("coverage"), (share < 0.95).alias("stale"))


@query(
    """with member as (select distinct artist_id as list_id, spotify_track_id as id from documents where artist_id is not null and spotify_track_id is not null), ok as (select distinct spotify_track_id as id from track_features),
  m as (select b.list_id, b.id, t.duplicate_of from member b left join track_meta t on t.spotify_track_id = b.id)
  select list_id, count(*) as n, count(*) filter (where id in (select id from ok where id is not null) or duplicate_of in (select id from ok where id is not null)) as covered from m group by 1"""
)
def list_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Members of each list that are analysed, themselves or through their canonical track."""
    member = table(spark, root, "documents").where("artist_id is not null and spotify_track_id is not null").select(F.col("artist_id").alias("list_id"), F.col("spotify_track_id").alias("id")).distinct()
    ok = table(spark, root, "track_features").where("spotify_track_id is not null").select(F.col("spotify_track_id").alias("k")).distinct()
    twin = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), "duplicate_of")
    m = member.join(twin, "id", "left").join(ok.select(F.col("k").alias("id"), F.lit(1).alias("own")), "id", "left").join(ok.select(F.col("k").alias("duplicate_of"), F.lit(1).alias("via")), "duplicate_of", "left")
    return m.groupBy("list_id").agg(F.count("*").alias("n"), F.count_if(F.col("own").isNotNull() | F.col("via").isNotNull()).alias("covered"))


@query("select regexp_extract(album_image_url, '^https?://([^/]+)', 1) as host, count(*) as n, count(distinct album_id) as n_albums from track_meta where album_image_url like 'http%' group by 1")
def image_hosts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "track_meta").where(F.col("album_image_url").startswith("http"))
    return rows.groupBy(F.regexp_extract("album_image_url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.count_distinct("album_id").alias("n_albums"))


@query(
    f"""with {LISTEN_SQL}, {ARTIST_SQL}, t as (select l.time_range, a.artist_id, lower(trim(g)) as genre from listen l join track_meta m on m.spotify_track_id = l.id join artists a on a.artist_id = m.primary_artist_id, unnest(string_split(a.genres, ',')) u(g) where trim(g) <> '')
  select time_range, count(distinct genre) as n_genres, count(distinct artist_id) as n_artists, count(*) as n from t group by 1"""
)
def genre_diversity(spark: SparkSession, root: str) -> DataFrame:
    """Genres and artists per listening window."""
    m = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), F.col("primary_artist_id").alias("artist_id"))
    t = listen(spark, root).join(m, "id").join(artists(spark, root), "artist_id").select("time_range", "artist_id", F.explode(F.split("genres", ",")).alias("g")).select("time_range", "artist_id", F.lower(F.trim("g")).alias("genre")).where("genre <> ''")
    return t.groupBy("time_range").agg(F.count_distinct("genre").alias("n_genres"), F.count_distinct("artist_id").alias("n_artists"), F.count("*").alias("n"))


@query(
    """with l as (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding) as v from embeddings), r as (select label, pos, cast(v as double) as v, row_number() over (partition by label, pos order by v) as k, count(*) over (partition by label, pos) as n from l)
  select label, cast(pos as bigint) as pos, round(max(case when k = cast(floor(0.25 * (n - 1)) as bigint) + 1 then v end), 7) as low, round(max(case when k = cast(floor(0.5 * (n - 1)) as bigint) + 1 then v end), 7) as middle, round(max(case when k = cast(floor(0.75 * (n - 1)) as bigint) + 1 then v end), 7) as high from r where n >= 5 group by 1, 2"""
)
def pointwise_band(spark: SparkSession, root: str) -> DataFrame:
    """Lower nearest-rank quartiles of five or more curves at each point, not interpolated."""
    long = table(spark, root, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.col("v").cast("double").alias("v"))
    c = running_total(long.groupBy("label", "pos", "v").agg(F.count("*").alias("n")), ["label", "pos"], "v", "n").where("_all >= 5")

    def at(share: float):
        place = F.floor((F.col("_all") - 1) * share)
        return F.round(F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("n")), F.col("v"))), 7)

    return c.groupBy("label", "pos").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"))
