"""Rollups by artist, album, decade and cluster, corpus facts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.durable import Scratch
from undertone.operators.aggregates import banded
from undertone.operators.ranking import quantiles
from undertone.plans.base import FEATS_SQL, PERC_SQL, TWINS_SQL, feats, perc, twins
from undertone.plans.joins import ARTIST_SQL, CARD_SQL, YEAR_SQL, artists, card, year_of
from undertone.plans.registry import query
from undertone.tables import table


@query(
    f"""with {PERC_SQL}, {TWINS_SQL} select m.primary_artist_id as artist_id, count(*) as n_tracks, count(p.id) as n_analyzed, round(avg(p.energy), 9) as energy, round(avg(p.tempo), 9) as tempo
  from track_meta m left join perc p on p.id = m.spotify_track_id where m.primary_artist_id is not null and m.spotify_track_id not in (select id from twins) group by 1"""
)
def artist_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Per artist id, twins left out; null ids have no group."""
    meta = table(spark, root, "track_meta").where("primary_artist_id is not null").select(F.col("spotify_track_id").alias("id"), F.col("primary_artist_id").alias("artist_id"))
    p = perc(spark, root).select("id", "energy", "tempo", F.lit(1).alias("known"))
    rows = meta.join(twins(spark, root), "id", "left_anti").join(p, "id", "left")
    return rows.groupBy("artist_id").agg(F.count("*").alias("n_tracks"), F.count("known").alias("n_analyzed"), F.round(F.avg("energy"), 9).alias("energy"), F.round(F.avg("tempo"), 9).alias("tempo"))


@query(
    f"""with {PERC_SQL} select lower(album_name) as album, album_type, count(*) as n_tracks, min(album_release_date) as released, min(album_image_url) as art, round(avg(energy), 9) as energy, round(avg(loudness_db), 9) as loudness
  from track_meta m left join perc p on p.id = m.spotify_track_id where album_name is not null group by 1, 2"""
)
def album_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Albums by folded name and type, not by id."""
    meta = table(spark, root, "track_meta").where("album_name is not null")
    p = perc(spark, root).select(F.col("id").alias("spotify_track_id"), "energy", "loudness_db")
    return meta.join(p, "spotify_track_id", "left").groupBy(F.lower("album_name").alias("album"), "album_type").agg(
        F.count("*").alias("n_tracks"), F.min("album_release_date").alias("released"), F.min("album_image_url").alias("art"), F.round(F.avg("energy"), 9).alias("energy"), F.round(F.avg("loudness_db"), 9).alias("loudness")
    )


@query(
    f"""with {CARD_SQL} select cast(floor(year / 10) * 10 as integer) as decade, count(*) as n_tracks, round(avg(loudness_db) filter (where abs(loudness_db) < 1e6), 9) as mean_loudness, round(median(loudness_db), 9) as median_loudness,
  round(avg(tempo) filter (where abs(tempo) < 1e6), 9) as tempo, round(avg(duration_sec) filter (where abs(duration_sec) < 1e6), 9) as duration, count(distinct primary_artist_id) as n_artists from card
  where feature_valid and year is not null group by 1 having count(*) >= 20"""
)
def era_profile(spark: SparkSession, root: str) -> DataFrame:
    """Decades with at least 20 valid tracks; values of a million and more stay out of means, which they would swamp."""
    decade = (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")
    rows = card(spark, root).where("feature_valid and year is not null").select(decade, "loudness_db", "tempo", "duration_sec", "primary_artist_id")
    rows = Scratch(spark, "eras").save(rows)

    def mean(c: str, out: str):
        return F.round(F.avg(F.when(F.abs(c) < 1e6, F.col(c))), 9).alias(out)

    one = rows.groupBy("decade").agg(F.count("*").alias("n_tracks"), mean("loudness_db", "mean_loudness"), mean("tempo", "tempo"), mean("duration_sec", "duration"), F.count_distinct("primary_artist_id").alias("n_artists")).where("n_tracks >= 20")
    middle = quantiles(rows, ["decade"], "loudness_db", [0.5]).select("decade", F.round(F.col("p")[0], 9).alias("median_loudness"))
    return one.join(middle, "decade", "left").select("decade", "n_tracks", "mean_loudness", "median_loudness", "tempo", "duration", "n_artists")


@query(
    f"""with {CARD_SQL}, {TWINS_SQL} select count(*) as n_tracks, count(*) filter (where feature_valid) as n_valid, round(avg(tempo) filter (where feature_valid and abs(tempo) < 1e6), 9) as tempo,
  round(median(energy) filter (where feature_valid), 9) as energy_median, count(distinct primary_artist_id) as n_artists, (select count(*) from twins) as n_twins from card"""
)
def corpus_facts(spark: SparkSession, root: str) -> DataFrame:
    valid = F.col("feature_valid")
    rows = Scratch(spark, "facts").save(card(spark, root).select("feature_valid", "tempo", "energy", "primary_artist_id"))
    one = rows.agg(
        F.count("*").alias("n_tracks"), F.count_if(valid).alias("n_valid"), F.round(F.avg(F.when(valid & (F.abs("tempo") < 1e6), F.col("tempo"))), 9).alias("tempo"), F.count_distinct("primary_artist_id").alias("n_artists")
    )
    middle = quantiles(rows.where(valid).withColumn("all", F.lit(0)), ["all"], "energy", [0.5]).select(F.round(F.col("p")[0], 9).alias("energy_median"))
    whole = one.join(F.broadcast(middle), F.lit(True), "left").join(F.broadcast(twins(spark, root).agg(F.count("*").alias("n_twins"))), F.lit(True))
    return whole.select("n_tracks", "n_valid", "tempo", "energy_median", "n_artists", "n_twins")


@query(
    f"""with {PERC_SQL}, mx as (select max(model_id) as m from track_clusters), ids as (select distinct model_id, cluster_id from track_clusters where cluster_id is not null),
  labels as (select distinct cluster_id from ids), lab as (select spotify_track_id as id, min(cluster_id) as cluster_id from track_clusters, mx where model_id = m and cluster_id is not null group by 1),
  a as (select cluster_id, count(*) as n, avg(energy) as energy, avg(tempo) filter (where abs(tempo) < 1e6) as tempo from lab join perc using (id) group by 1)
  select l.cluster_id, coalesce(n, 0) as n, round(coalesce(n, 0) / (select sum(n) from a), 9) as share, round(energy, 9) as energy, round(tempo, 9) as tempo from labels l left join a using (cluster_id)"""
)
def cluster_profile(spark: SparkSession, root: str) -> DataFrame:
    """One row per cluster label, empty clusters included."""
    clusters = table(spark, root, "track_clusters").where("cluster_id is not null")
    newest = table(spark, root, "track_clusters").agg(F.max("model_id").alias("m"))
    labels = clusters.select("cluster_id").distinct()
    lab = clusters.join(F.broadcast(newest), F.col("model_id") == F.col("m")).groupBy(F.col("spotify_track_id").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    a = lab.join(perc(spark, root), "id").groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("energy").alias("energy"), F.avg(F.when(F.abs("tempo") < 1e6, F.col("tempo"))).alias("tempo"))
    whole = a.agg(F.sum("n").alias("whole"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return labels.join(a, "cluster_id", "left").join(F.broadcast(whole), F.lit(True)).select("cluster_id", n.alias("n"), F.round(n / F.col("whole"), 9).alias("share"), F.round("energy", 9).alias("energy"), F.round("tempo", 9).alias("tempo"))


@query(
    f"""with {ARTIST_SQL}, tok as (select distinct artist_id, lower(trim(g)) as genre from (select artist_id, unnest(string_split(genres, ',')) as g from artists where genres is not null) where trim(g) <> '')
  select genre, count(*) as n_artists from tok group by 1 order by count(*) desc, genre limit 15"""
)
def genre_strip(spark: SparkSession, root: str) -> DataFrame:
    """Most frequent comma tokens, counted once per artist; ties by name."""
    tok = artists(spark, root).select("artist_id", F.explode(F.split("genres", ",")).alias("g")).select("artist_id", F.lower(F.trim("g")).alias("genre")).where("genre <> ''").distinct()
    return tok.groupBy("genre").agg(F.count("*").alias("n_artists")).orderBy(F.desc("n_artists"), "genre").limit(15)


# Ordered genre rules, the first whose keywords occur in any genre wins.
BUCKETS = [
    ("Metal", ("metal", "metalcore", "djent")),
    ("Punk & Emo", ("punk", "emo", "screamo", "hardcore", "grunge")),
    ("Folk", ("folk", "acoustic", "singer-songwriter", "americana")),
    ("Classical", ("classical", "opera", "orchestra", "baroque")),
    ("Jazz", ("jazz", "bossa nova", "swing")),
    ("Blues", ("blues",)),
    ("Hip-Hop", ("hip hop", "hip-hop", "rap", "trap", "drill")),
    ("Electronic", ("electronic", "edm", "house", "techno", "dubstep", "synthwave", "drum and bass", "dance", "electro")),
    ("R&B & Funk", ("r&b", "rnb", "soul", "funk", "motown")),
    ("Country", ("country", "bluegrass")),
    ("Latin", ("latin", "reggaeton", "salsa", "bachata")),
    ("Indie & Alt", ("indie", "alternative", "britpop", "madchester", "new wave", "garage", "shoegaze", "lo-fi", "post-")),
    ("Pop", ("pop", "synthpop")),
    ("Rock", ("rock", "rock and roll")),
]
_BUCKET_SQL = (
    "case when genres is null or len(list_filter(list_transform(string_split(genres, ','), lambda x: trim(x)), lambda x: x <> '')) = 0 then 'Unknown' "
    + " ".join("when " + " or ".join(f"contains(lower(genres), '{k}')" for k in keys) + f" then '{name}'" for name, keys in BUCKETS) + " else 'Other' end"
)


@query(f"with {ARTIST_SQL} select {_BUCKET_SQL} as bucket, count(*) as n_artists, cast(sum(followers) as bigint) as followers from artists group by 1")
def genre_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Artists by coarse genre; no keyword holds a comma, so the whole field is searched at once."""
    g = F.lower("genres")
    tags = F.filter(F.transform(F.split("genres", ","), lambda x: F.trim(x)), lambda x: x != "")
    bucket = F.when(F.col("genres").isNull() | (F.size(tags) == 0), "Unknown")
    for name, keys in BUCKETS:
        bucket = bucket.when(F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(g, k)), name)
    return artists(spark, root).groupBy(bucket.otherwise("Other").alias("bucket")).agg(F.count("*").alias("n_artists"), F.sum("followers").alias("followers"))


_DRIFT_ARTIST_SQL = f"""with {FEATS_SQL}, albums as (select primary_artist_id as artist_id, lower(album_name) as album, min({YEAR_SQL}) as y, avg(20 * log10(greatest(rms_mean, 1e-9))) as e
  from track_meta m join feats f on f.id = m.spotify_track_id where primary_artist_id is not null and album_name is not null and rms_mean is not null group by 1, 2),
 d as (select artist_id, count(*) as n_albums, coalesce(regr_slope(e, y), 0) as slope, min(y) as y0, max(y) as y1, min(e) as low, max(e) as high, arg_min(e, (y, album)) as first, arg_max(e, (y, album)) as last
   from albums where y is not null group by 1 having count(*) >= 3),
 s as (select *, case when high > low then high - low else 1 end as reach from d)"""


@query(
    f"""{_DRIFT_ARTIST_SQL} select artist_id, n_albums, round(slope, 5) as slope_per_year, round(last - first, 4) as delta, case when abs(slope * (y1 - y0)) < 0.2 * reach then 'flat' when slope > 0 then 'up' else 'down' end as direction,
  case when (high > greatest(first, last) or low < least(first, last)) and abs(last - first) < 0.5 * reach then 'arc' else 'trend' end as shape from s"""
)
def artist_drift(spark: SparkSession, root: str) -> DataFrame:
    """Least-squares trend of the measured level of an artist's albums over the years, three albums or more.

    The level is in dBFS from the extraction, not a rank. A trend is flat under a
    fifth of the artist's own range; an arc peaks inside and ends near its start.
    """
    level = 20 * F.log10(F.greatest(F.col("rms_mean"), F.lit(1e-9)))
    f = feats(spark, root).where("rms_mean is not null").select(F.col("id").alias("spotify_track_id"), level.alias("level"))
    meta = table(spark, root, "track_meta").where("primary_artist_id is not null and album_name is not null")
    albums = meta.join(f, "spotify_track_id").groupBy(F.col("primary_artist_id").alias("artist_id"), F.lower("album_name").alias("album")).agg(F.min(year_of("album_release_date")).alias("y"), F.avg("level").alias("e"))
    when = F.struct("y", "album")
    d = albums.where("y is not null").groupBy("artist_id").agg(
        F.count("*").alias("n_albums"), F.coalesce(F.regr_slope("e", F.col("y").cast("double")), F.lit(0.0)).alias("slope"), (F.max("y") - F.min("y")).alias("span"),
        F.min("e").alias("low"), F.max("e").alias("high"), F.min_by("e", when).alias("first"), F.max_by("e", when).alias("last"),
    ).where("n_albums >= 3")
    reach = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    delta = F.col("last") - F.col("first")
    inside = (F.col("high") > F.greatest("first", "last")) | (F.col("low") < F.least("first", "last"))
    way = F.when(F.abs(F.col("slope") * F.col("span")) < 0.2 * reach, "flat").when(F.col("slope") > 0, "up").otherwise("down")
    return d.select("artist_id", "n_albums", F.round("slope", 5).alias("slope_per_year"), F.round(delta, 4).alias("delta"), way.alias("direction"), F.when(inside & (F.abs(delta) < 0.5 * reach), "arc").otherwise("trend").alias("shape"))


@query(
    f"""with {PERC_SQL}, g as (select stddev_pop(energy) as se from perc), a as (select primary_artist_id as artist_id, count(*) as n, stddev_pop(energy) as s, avg(energy) as m from track_meta t join perc p on p.id = t.spotify_track_id
  where primary_artist_id is not null and energy is not null group by 1 having count(*) >= 3) select artist_id, n, round(m, 9) as energy, round(s / se, 9) as spread, s / se > 1 as wide from a, g"""
)
def artist_spread(spark: SparkSession, root: str) -> DataFrame:
    """Spread of an artist against the corpus, three tracks or more."""
    p = perc(spark, root).select(F.col("id").alias("spotify_track_id"), "energy")
    whole = p.agg(F.stddev_pop("energy").alias("se"))
    a = table(spark, root, "track_meta").where("primary_artist_id is not null").join(p.where("energy is not null"), "spotify_track_id").groupBy(F.col("primary_artist_id").alias("artist_id"))
    a = a.agg(F.count("*").alias("n"), F.stddev_pop("energy").alias("s"), F.avg("energy").alias("m")).where("n >= 3")
    return a.join(F.broadcast(whole), F.lit(True)).select("artist_id", "n", F.round("m", 9).alias("energy"), F.round(F.col("s") / F.col("se"), 9).alias("spread"), (F.col("s") / F.col("se") > 1).alias("wide"))


@query("select round(avg(popularity), 9) as mean, round(stddev_pop(popularity), 9) as std, count(popularity) as n, median(popularity) as median from track_meta having count(popularity) >= 2")
def popularity_stats(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "track_meta").agg(
        F.round(F.avg("popularity"), 9).alias("mean"), F.round(F.stddev_pop("popularity"), 9).alias("std"), F.count("popularity").alias("n"), F.percentile("popularity", F.lit(0.5)).alias("median")
    ).where("n >= 2")


@query(
    """select case when match_confidence is null then 'none' when match_confidence < 0.25 then '<0.25' when match_confidence < 0.5 then '0.25-0.5' when match_confidence < 0.75 then '0.5-0.75' else '>=0.75' end as bucket,
  extraction_source, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 9) as pct from track_features group by 1, 2"""
)
def provenance_report(spark: SparkSession, root: str) -> DataFrame:
    """Half-open confidence buckets by extraction source with their share of all rows."""
    c = F.col("match_confidence")
    bucket = F.when(c.isNull(), "none").otherwise(banded(c, [(0.25, "<0.25"), (0.5, "0.25-0.5"), (0.75, "0.5-0.75")], ">=0.75"))
    g = table(spark, root, "track_features").groupBy(bucket.alias("bucket"), "extraction_source").agg(F.count("*").alias("n"))
    whole = g.agg(F.sum("n").alias("whole"))
    return g.join(F.broadcast(whole), F.lit(True)).select("bucket", "extraction_source", "n", F.round(100.0 * F.col("n") / F.col("whole"), 9).alias("pct"))


@query("select source, lang, grouping(source) as g_source, grouping(lang) as g_lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by grouping sets ((source, lang), (source), (lang), ())")
def document_cube(spark: SparkSession, root: str) -> DataFrame:
    """Counts by every combination of source and language."""
    return table(spark, root, "documents").cube("source", "lang").agg(
        F.grouping("source").cast("long").alias("g_source"), F.grouping("lang").cast("long").alias("g_lang"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")
    )


@query(
    f"""with {FEATS_SQL} select count(*) as n, max(extracted_at) as newest, round(sum(tempo_bpm), 3) as tempo, round(sum(rms_mean), 3) as rms, round(sum(harmonic_ratio), 3) as harmonic from feats"""
)
def population_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    return feats(spark, root).agg(F.count("*").alias("n"), F.max("extracted_at").alias("newest"), *[F.round(F.sum(c), 3).alias(o) for c, o in (("tempo_bpm", "tempo"), ("rms_mean", "rms"), ("harmonic_ratio", "harmonic"))])


@query(
    """with o as (select l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax from lineitem where l_shipdate <= timestamp '1998-09-02')
  select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 9) as discount, count(*) as n from o group by 1, 2"""
)
def pricing_summary(spark: SparkSession, root: str) -> DataFrame:
    """A plain scan and aggregate over the largest star table."""
    rows = table(spark, root, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("discount"), F.count("*").alias("n")
    )


@query(
    f"""with {PERC_SQL}, u as (select avg(energy) as e, avg(danceability) as d, avg(acousticness) as a from perc where id in (select track_id from dedup_records where is_cached)),
  s as (select avg(energy) as me, stddev_pop(energy) as se, avg(danceability) as md, stddev_pop(danceability) as sd, avg(acousticness) as ma, stddev_pop(acousticness) as sa from perc)
  select 'energy' as dim, round((e - me) / se, 5) as z, round(least(1, abs((e - me) / se) / 2), 5) as strength from u, s union all select 'danceability', round((d - md) / sd, 5), round(least(1, abs((d - md) / sd) / 2), 5) from u, s
  union all select 'acousticness', round((a - ma) / sa, 5), round(least(1, abs((a - ma) / sa) / 2), 5) from u, s"""
)
def acoustic_signature(spark: SparkSession, root: str) -> DataFrame:
    """Mean of a listener's tracks in population spreads of the corpus."""
    dims = ["energy", "danceability", "acousticness"]
    p = perc(spark, root).select("id", *dims)
    mine = table(spark, root, "dedup_records").where("is_cached").select(F.col("track_id").alias("id"))
    u = p.join(mine, "id", "left_semi").agg(*[F.avg(c).alias(f"u_{c}") for c in dims])
    s = p.agg(*[F.avg(c).alias(f"m_{c}") for c in dims], *[F.stddev_pop(c).alias(f"s_{c}") for c in dims])
    z = {c: (F.col(f"u_{c}") - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in dims}
    rows = F.array(*[F.struct(F.lit(c).alias("dim"), F.round(z[c], 5).alias("z"), F.round(F.least(F.lit(1.0), F.abs(z[c]) / 2), 5).alias("strength")) for c in dims])
    return u.join(F.broadcast(s), F.lit(True)).select(F.inline(rows))


@query(
    """with top as (select artist_id, count(*) as n from documents where artist_id is not null group by 1)
  select case when n >= 100 then 'hot' when n >= 10 then 'warm' else 'cold' end as heat, count(*) as n_artists, cast(sum(n) as bigint) as n_docs from top group by 1"""
)
def artist_heat(spark: SparkSession, root: str) -> DataFrame:
    top = table(spark, root, "documents").where("artist_id is not null").groupBy("artist_id").agg(F.count("*").alias("n"))
    return top.groupBy(F.when(F.col("n") >= 100, "hot").when(F.col("n") >= 10, "warm").otherwise("cold").alias("heat")).agg(F.count("*").alias("n_artists"), F.sum("n").alias("n_docs"))


def windowed_counts(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Tumbling counts; the same expression serves batch and stream."""
    return df.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
