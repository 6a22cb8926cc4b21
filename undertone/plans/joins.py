"""Catalogue joins: track card, library rows, artists, semi and anti joins, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.durable import Scratch
from undertone.functions.vectors import euclid
from undertone.operators.models import nearest_k
from undertone.operators.ranking import top_per_group
from undertone.plans.base import FEATS_SQL, LISTEN_SQL, PERC_SQL, SEED_SQL, SIMILARITY, TWINS_SQL, canonical, excluded, feats, is_seed, listen, perc
from undertone.plans.registry import query
from undertone.tables import table

YEAR_SQL = "case when try_cast(substr(album_release_date, 1, 4) as integer) between 1900 and 2100 and regexp_matches(substr(album_release_date, 1, 4), '^[0-9]{4}$') then try_cast(substr(album_release_date, 1, 4) as integer) end"
ARTIST_SQL = """artists as (select artist_id, artist_name, genres, followers, popularity from artist_meta where artist_id is not null
  qualify row_number() over (partition by artist_id order by updated_at desc nulls last, artist_name desc nulls last) = 1)"""
CARD_SQL = f"""{PERC_SQL}, {ARTIST_SQL},
card as (select p.*, coalesce(m.track_name, p.id) as name, coalesce(a.artist_name, '') as artist, m.primary_artist_id, m.popularity, m.duplicate_of, m.duration_ms,
  {YEAR_SQL.replace('album_release_date', 'm.album_release_date')} as year, p.tempo > 1 and p.loudness_db > -80 as feature_valid
  from perc p left join track_meta m on m.spotify_track_id = p.id left join artists a on a.artist_id = m.primary_artist_id)"""


def year_of(date: str):
    """Release year of a date of any precision, null outside 1900 to 2100."""
    head = F.substring(date, 1, 4)
    y = F.when(head.rlike(r"^[0-9]{4}$"), head.try_cast("int"))
    return F.when(y.between(1900, 2100), y)


def artists(spark: SparkSession, root: str) -> DataFrame:
    """Newest row of every artist."""
    rows = table(spark, root, "artist_meta").where("artist_id is not null")
    w = Window.partitionBy("artist_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("artist_name"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("artist_id", "artist_name", "genres", "followers", "popularity")


def card(spark: SparkSession, root: str) -> DataFrame:
    """Perceptual rows with names, release year and validity."""
    meta = table(spark, root, "track_meta").select(
        F.col("spotify_track_id").alias("id"), "track_name", "primary_artist_id", "popularity", "duplicate_of", "duration_ms", year_of("album_release_date").alias("year")
    )
    names = artists(spark, root).select(F.col("artist_id").alias("primary_artist_id"), "artist_name")
    rows = perc(spark, root).join(meta, "id", "left").join(names, "primary_artist_id", "left")
    return rows.withColumn("name", F.coalesce("track_name", "id")).withColumn("artist", F.coalesce("artist_name", F.lit(""))).withColumn("feature_valid", (F.col("tempo") > 1) & (F.col("loudness_db") > -80)).drop("track_name", "artist_name")


@query(f"with {CARD_SQL} select id, name, artist, popularity, year, cast(floor(year / 10) * 10 as integer) as decade, feature_valid, energy, tempo from card")
def track_card(spark: SparkSession, root: str) -> DataFrame:
    return card(spark, root).select("id", "name", "artist", "popularity", "year", (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"), "feature_valid", "energy", "tempo")


@query(
    f"with {ARTIST_SQL} select m.spotify_track_id as id, a.artist_name, coalesce(a.genres, '') as genres, a.followers from track_meta m left join artists a on a.artist_id = m.primary_artist_id"
)
def tracks_with_artist(spark: SparkSession, root: str) -> DataFrame:
    """Left join on keys of different names, missing genres as an empty text."""
    meta = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), "primary_artist_id")
    return meta.join(artists(spark, root), F.col("primary_artist_id") == F.col("artist_id"), "left").select("id", "artist_name", F.coalesce("genres", F.lit("")).alias("genres"), "followers")


@query(
    f"""with {FEATS_SQL} select m.spotify_track_id as id, f.id is not null as analyzed,
  case when f.id is null then null when f.match_confidence < 0.5 then 'low' else 'ok' end as provenance,
  case when m.album_image_url like 'http%' then m.album_image_url end as image from track_meta m left join feats f on f.id = m.spotify_track_id"""
)
def library_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every catalogue row with its analysis state and provenance."""
    f = feats(spark, root).select("id", "match_confidence", F.lit(True).alias("known"))
    meta = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), "album_image_url")
    state = F.when(F.col("known").isNull(), F.lit(None)).when(F.col("match_confidence") < 0.5, "low").otherwise("ok")
    return meta.join(f, "id", "left").select("id", F.col("known").isNotNull().alias("analyzed"), state.alias("provenance"), F.when(F.col("album_image_url").startswith("http"), F.col("album_image_url")).alias("image"))


@query("select spotify_track_id as id from track_meta where spotify_track_id not in (select spotify_track_id from track_features where spotify_track_id is not null)")
def missing_features(spark: SparkSession, root: str) -> DataFrame:
    have = table(spark, root, "track_features").select("spotify_track_id")
    return table(spark, root, "track_meta").join(have, "spotify_track_id", "left_anti").select(F.col("spotify_track_id").alias("id"))


@query("select spotify_track_id as id from track_meta where spotify_track_id in (select track_id from dedup_records where is_cached)")
def cached_tracks(spark: SparkSession, root: str) -> DataFrame:
    have = table(spark, root, "dedup_records").where("is_cached").select(F.col("track_id").alias("spotify_track_id"))
    return table(spark, root, "track_meta").join(have, "spotify_track_id", "left_semi").select(F.col("spotify_track_id").alias("id"))


@query(f"with {TWINS_SQL} select id from excluded")
def excluded_tracks(spark: SparkSession, root: str) -> DataFrame:
    return excluded(spark, root)


@query(f"with {TWINS_SQL} select id from canonical")
def canonical_tracks(spark: SparkSession, root: str) -> DataFrame:
    return canonical(spark, root)


@query(
    f"with {TWINS_SQL}, {PERC_SQL} select 'excluded_in_mart' as name, count(*) as n from perc where id in (select id from excluded) union all select 'mart_outside_catalogue', count(*) from perc where id not in (select spotify_track_id from track_meta where spotify_track_id is not null)"
)
def plane_coherence(spark: SparkSession, root: str) -> DataFrame:
    """Counts of rows that break the rules between the planes."""
    p = perc(spark, root).select("id")
    bad = p.join(excluded(spark, root), "id", "left_semi").select(F.lit("excluded_in_mart").alias("name"))
    meta = table(spark, root, "track_meta").where("spotify_track_id is not null").select(F.col("spotify_track_id").alias("id"))
    out = p.join(meta, "id", "left_anti").select(F.lit("mart_outside_catalogue").alias("name"))
    names = spark.createDataFrame([("excluded_in_mart",), ("mart_outside_catalogue",)], "name string")
    counts = bad.unionByName(out).groupBy("name").agg(F.count("*").alias("n"))
    return names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""with {LISTEN_SQL}, {PERC_SQL}, whole as (select avg(energy) as e, avg(danceability) as d from perc), mine as (
  select time_range, count(*) as n, avg(energy) as energy, avg(danceability) as dance from listen join perc using (id) group by 1 having count(*) >= 2)
  select time_range, n, round(energy / e - 1, 5) as energy_diff, round(dance / d - 1, 5) as dance_diff, case when abs(energy / e - 1) <= 0.08 then 'on par' when energy > e then 'above' else 'below' end as energy_word from mine, whole"""
)
def overlap_profile(spark: SparkSession, root: str) -> DataFrame:
    """Windows against the whole corpus; windows with fewer than two known tracks are left out."""
    p = perc(spark, root).select("id", "energy", "danceability")
    whole = p.agg(F.avg("energy").alias("e"), F.avg("danceability").alias("d"))
    mine = listen(spark, root).join(p, "id").groupBy("time_range").agg(F.count("*").alias("n"), F.avg("energy").alias("energy"), F.avg("danceability").alias("dance")).where("n >= 2")
    diff = F.col("energy") / F.col("e") - 1
    return mine.join(F.broadcast(whole), F.lit(True)).select(
        "time_range", "n", F.round(diff, 5).alias("energy_diff"), F.round(F.col("dance") / F.col("d") - 1, 5).alias("dance_diff"),
        F.when(F.abs(diff) <= 0.08, "on par").when(F.col("energy") > F.col("e"), "above").otherwise("below").alias("energy_word"),
    )


@query(
    """with member as (select distinct artist_id as playlist_id, spotify_track_id as id from documents where artist_id is not null and spotify_track_id is not null),
  sized as (select * from member qualify count(*) over (partition by playlist_id) between 2 and 200),
  known as (select s.*, m.primary_artist_id as artist from sized s join track_meta m on m.spotify_track_id = s.id)
  select a.id as id, count(distinct b.id) as n_related from known a join known b on a.playlist_id = b.playlist_id and a.id <> b.id
  where a.artist is null or b.artist is null or a.artist <> b.artist group by 1"""
)
def cooccurrence(spark: SparkSession, root: str) -> DataFrame:
    """Tracks that share a list of 2 to 200 tracks, pairs of one artist left out."""
    docs = table(spark, root, "documents").where("artist_id is not null and spotify_track_id is not null")
    member = docs.select(F.col("artist_id").alias("playlist_id"), F.col("spotify_track_id").alias("id")).distinct()
    sizes = member.groupBy("playlist_id").agg(F.count("*").alias("n")).where("n between 2 and 200").select("playlist_id")
    meta = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), F.col("primary_artist_id").alias("artist"))
    known = member.join(sizes, "playlist_id", "left_semi").join(meta, "id")
    a, b = known.select("playlist_id", F.col("id").alias("ia"), F.col("artist").alias("aa")), known.select("playlist_id", F.col("id").alias("ib"), F.col("artist").alias("ab"))
    pairs = a.join(b, "playlist_id").where("ia <> ib and (aa is null or ab is null or aa <> ab)")
    return pairs.groupBy(F.col("ia").alias("id")).agg(F.count_distinct("ib").alias("n_related"))


_Z_SQL = f"""with {FEATS_SQL}, st as (select """ + ", ".join(f"avg(coalesce({c}, 0)) as m_{c}, stddev_pop(coalesce({c}, 0)) as s_{c}" for c in SIMILARITY) + """ from feats),
z as (select id, """ + ", ".join(f"(coalesce({c}, 0) - m_{c}) / case when s_{c} > 0 then s_{c} else 1 end as {c}" for c in SIMILARITY) + " from feats, st)"


def similarity_plane(spark: SparkSession, root: str) -> DataFrame:
    """Scaled similarity vectors of all tracks, missing values as 0 before scaling."""
    rows = feats(spark, root).select("id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in SIMILARITY])
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in SIMILARITY], *[F.stddev_pop(c).alias(f"s_{c}") for c in SIMILARITY])
    z = [(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in SIMILARITY]
    return rows.join(F.broadcast(stats), F.lit(True)).select("id", F.array(*z).alias("v"))


@query(
    f"{_Z_SQL}, seed as (select * from z where id = (select min(id) from z)) select z.id, round(sqrt("
    + " + ".join(f"power(z.{c} - seed.{c}, 2)" for c in SIMILARITY)
    + ") , 5) as distance from z, seed where z.id <> seed.id order by sqrt(" + " + ".join(f"power(z.{c} - seed.{c}, 2)" for c in SIMILARITY) + "), z.id limit 6"
)
def similar_tracks(spark: SparkSession, root: str) -> DataFrame:
    """The six nearest tracks of one seed, exactly: one broadcast row against a scan."""
    z = similarity_plane(spark, root)
    seed = z.orderBy("id").limit(1).select(F.col("id").alias("seed"), F.col("v").alias("sv"))
    d = euclid(F.col("v"), F.col("sv"))
    return z.join(F.broadcast(seed), F.lit(True)).where("id <> seed").select("id", d.alias("d")).orderBy("d", "id").limit(6).select("id", F.round("d", 5).alias("distance"))


_D_SQL = "sqrt(" + " + ".join(f"power(z.{c} - seed.{c}, 2)" for c in SIMILARITY) + ")"


@query(
    f"""{_Z_SQL}, seed as (select * from z where {SEED_SQL}), d as (select seed.id as seed, z.id as item, {_D_SQL} as d from z join seed on z.id <> seed.id)
  select seed, item, rank, round(d, 5) as distance from (select *, row_number() over (partition by seed order by d, item) as rank from d) where rank <= 6"""
)
def similar_search(spark: SparkSession, root: str) -> DataFrame:
    """The six nearest tracks of every 50th track, exactly; ``similar_tracks`` is its lookup for one seed."""
    z = Scratch(spark, "similar").save(similarity_plane(spark, root))
    near = nearest_k(z, "id", "v", z.where(is_seed("id")), 6)
    return near.select("seed", "item", F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"))


_CENT = ["tempo", "energy", "danceability", "acousticness"]


@query(
    f"""with {PERC_SQL}, mx as (select max(model_id) as m from track_clusters),
  lab as (select spotify_track_id as id, min(cluster_id) as c from track_clusters, mx where model_id = m and cluster_id is not null group by 1),
  ok as (select * from perc where {' and '.join(f'{c} is not null' for c in _CENT)} and abs(tempo) < 1000),
  st as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in _CENT)} from ok),
  z as (select id, {', '.join(f'({c} - m_{c}) / s_{c} as {c}' for c in _CENT)} from ok, st),
  cen as (select c, {', '.join(f'avg({c}) as {c}' for c in _CENT)} from z join lab using (id) group by 1),
  d as (select z.id, cen.c, round(sqrt({' + '.join(f'power(z.{c} - cen.{c}, 2)' for c in _CENT)}), 7) as d from z, cen)
  select id, c as cluster_id from d qualify row_number() over (partition by id order by d, c) = 1"""
)
def nearest_cluster(spark: SparkSession, root: str) -> DataFrame:
    """Cluster of the nearest centroid for every complete track; ties go to the smaller cluster.

    The centroids are one row per cluster of a trained model, a handful by
    construction, so they ride along as an array.
    """
    clusters = table(spark, root, "track_clusters")
    newest = clusters.agg(F.max("model_id").alias("m"))
    labels = clusters.where("cluster_id is not null").join(F.broadcast(newest), F.col("model_id") == F.col("m")).groupBy(F.col("spotify_track_id").alias("id")).agg(F.min("cluster_id").alias("c"))
    ok = perc(spark, root).dropna(subset=_CENT).where("abs(tempo) < 1000")
    st = ok.agg(*[F.avg(c).alias(f"m_{c}") for c in _CENT], *[F.stddev_pop(c).alias(f"s_{c}") for c in _CENT])
    z = ok.join(F.broadcast(st), F.lit(True)).select("id", F.array(*[(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in _CENT]).alias("v"))
    cen = z.join(labels, "id").groupBy("c").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(len(_CENT))]).alias("w"))
    every = cen.agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("all"))
    best = F.array_min(F.transform("all", lambda k: F.struct(F.round(euclid(F.col("v"), k["w"]), 7).alias("d"), k["c"].alias("c"))))
    return z.join(F.broadcast(every), F.lit(True)).select("id", best["c"].alias("cluster_id"))


@query(
    f"""with {ARTIST_SQL}, by_id as (select primary_artist_id as k, count(*) as n from track_meta where primary_artist_id is not null group by 1),
  named as (select b.k, b.n, lower(trim(a.artist_name)) as nm from by_id b left join artists a on a.artist_id = b.k),
  single as (select nm, min(k) as k from named where nm is not null group by 1 having count(*) = 1),
  loose as (select lower(trim(split_part(artist_names, ',', 1))) as nm, count(*) as n from track_meta where primary_artist_id is null and artist_names is not null group by 1),
  folded as (select coalesce(s.k, 'name:' || l.nm) as k, sum(l.n) as n from loose l left join single s on s.nm = l.nm group by 1)
  select k as artist_key, cast(sum(n) as bigint) as n_tracks from (select k, n from by_id union all select k, n from folded) group by 1"""
)
def artist_index(spark: SparkSession, root: str) -> DataFrame:
    """Tracks per artist id; rows without id join an id only if one id alone has their name."""
    meta = table(spark, root, "track_meta")
    by_id = meta.where("primary_artist_id is not null").groupBy(F.col("primary_artist_id").alias("k")).agg(F.count("*").alias("n"))
    named = by_id.join(artists(spark, root).select(F.col("artist_id").alias("k"), F.lower(F.trim("artist_name")).alias("nm")), "k", "left")
    single = named.where("nm is not null").groupBy("nm").agg(F.min("k").alias("k"), F.count("*").alias("c")).where("c = 1").select("nm", "k")
    first = F.lower(F.trim(F.split_part("artist_names", F.lit(","), F.lit(1))))
    loose = meta.where("primary_artist_id is null and artist_names is not null").groupBy(first.alias("nm")).agg(F.count("*").alias("n"))
    folded = loose.join(single, "nm", "left").select(F.coalesce("k", F.concat(F.lit("name:"), "nm")).alias("k"), "n")
    return by_id.unionByName(folded).groupBy(F.col("k").alias("artist_key")).agg(F.sum("n").alias("n_tracks"))


def _asof(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    seg = table(spark, root, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    ev = table(spark, root, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("date").alias("d"), F.struct("ts", "event_id", "event_type", "value").alias("e"))
    both = orders.select("k", "d", "o_orderkey", F.lit(None).cast("struct<ts:timestamp_ntz,event_id:bigint,event_type:string,value:double>").alias("e")).unionByName(ev.withColumn("o_orderkey", F.lit(None).cast("long")), allowMissingColumns=True)
    w = Window.partitionBy("k").orderBy("d", F.col("e").isNull(), "e.ts", "e.event_id").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("last", F.last("e", ignorenulls=True).over(w)).where("o_orderkey is not null")
    return filled.join(seg, "k").select("o_orderkey", "c_mktsegment", F.col("last.event_type").alias("event_type"), F.col("last.value").alias("value"))


@query(
    """select o_orderkey, c_mktsegment, event_type, value from (select o.o_orderkey, c.c_mktsegment, e.event_type, e.value,
  row_number() over (partition by o.o_orderkey order by e.ts desc nulls last, e.event_id desc nulls last) as r
  from orders o join customer c on c.c_custkey = o.o_custkey left join events e on e.user_id = o.o_custkey and cast(e.ts as date) <= cast(o.o_orderdate as date)) where r = 1"""
)
def asof_join(spark: SparkSession, root: str) -> DataFrame:
    """Each order with its customer's newest event so far: one sorted pass over the union, no range join."""
    return _asof(spark, root)
