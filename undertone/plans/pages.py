"""Pages over the library: filters, sort keys, paging, sampling, and a track's place in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.operators.aggregates import unpivot
from undertone.operators.ranking import average_rank_shares
from undertone.plans.base import FEATS_SQL, FEATURES, PERC_SQL, TWINS_SQL, feats, perc, twins
from undertone.plans.joins import ARTIST_SQL, CARD_SQL, artists, card
from undertone.plans.ranked import RAW_SHARES, raw_feature_stats
from undertone.plans.registry import query
from undertone.tables import table

# Sort keys of the library and the sizes of its pages.
SORT_KEYS = {"name": (["name"], False), "artist": (["artist", "name"], False), "popularity": (["popularity"], True), "tempo": (["tempo"], True), "energy": (["energy"], True), "brightness": (["brightness"], True)}
PAGE_SIZES, PAGE_SIZE = (50, 100, 250), 100


def sort_columns(key: str) -> list[Column]:
    """Order of a whitelisted key, unknown values last, ties by id; an unknown key sorts by name."""
    names, down = SORT_KEYS.get(key, SORT_KEYS["name"])
    return [F.desc_nulls_last(c) if down else F.lower(F.coalesce(c, F.lit(""))).asc() for c in names] + [F.col("id").asc()]


def page_bounds(n: int, page: str | int | None, per: str | int | None) -> tuple[int, int]:
    """``(offset, limit)`` of a page: sizes not offered become the default, pages are clamped, ``all`` is everything."""
    if per == "all":
        return 0, n
    size = int(per) if str(per).isdigit() and int(per) in PAGE_SIZES else PAGE_SIZE
    last = max(1, -(-n // size))
    wanted = int(page) if str(page).lstrip("-").isdigit() else 1
    return (min(max(wanted, 1), last) - 1) * size, size


def page_of(rows: DataFrame, key: str, page: str | int | None, per: str | int | None) -> DataFrame:
    """One page of the rows in a whitelisted order."""
    offset, limit = page_bounds(rows.count(), page, per)
    return rows.orderBy(*sort_columns(key)).limit(offset + limit).offset(offset)


@query(f"with {CARD_SQL} select id, name, tempo from card order by tempo desc nulls last, id limit 50 offset (select 50 * greatest(0, least(3, ceil(count(*) / 50.0)) - 1) from card)")
def sorted_page(spark: SparkSession, root: str) -> DataFrame:
    """Third page of 50 by tempo, or the last there is."""
    return page_of(card(spark, root).select("id", "name", "artist", "popularity", "tempo", "energy", "brightness"), "tempo", 3, 50).select("id", "name", "tempo")


@query(
    f"""with {ARTIST_SQL}, mine as (select distinct primary_artist_id as artist_id from dedup_records where is_cached), hit as (select a.* from artists a join mine using (artist_id)
  where list_contains(list_transform(string_split(a.genres, ','), lambda x: lower(trim(x))), 'dream pop') and contains(lower(a.artist_name), 'a'))
  select artist_id, artist_name, followers, (select count(*) from artists) as n_all from hit"""
)
def artist_page(spark: SparkSession, root: str) -> DataFrame:
    """Artists of the listener's tracks, then of a genre, then by name; the total counts all artists."""
    every = artists(spark, root)
    mine = table(spark, root, "dedup_records").where("is_cached").select(F.col("primary_artist_id").alias("artist_id")).distinct()
    genre = F.array_contains(F.transform(F.split("genres", ","), lambda x: F.lower(F.trim(x))), "dream pop")
    hit = every.join(mine, "artist_id", "left_semi").where(genre & F.contains(F.lower("artist_name"), F.lit("a")))
    return hit.join(F.broadcast(every.agg(F.count("*").alias("n_all"))), F.lit(True)).select("artist_id", "artist_name", "followers", "n_all")


@query(f"with {FEATS_SQL} select id, coalesce(tempo_bpm <= 1, false) as broken, match_confidence from feats order by 2 desc, 3 asc nulls last, 1 limit 100")
def extract_again(spark: SparkSession, root: str) -> DataFrame:
    """The hundred tracks to extract again first: broken ones, then the least trusted, unknown trust last."""
    rows = feats(spark, root).select("id", F.coalesce(F.col("tempo_bpm") <= 1, F.lit(False)).alias("broken"), "match_confidence")
    return rows.orderBy(F.desc("broken"), F.asc_nulls_last("match_confidence"), "id").limit(100)


@query(
    f"""with {PERC_SQL}, mine as (select distinct track_id as id from dedup_records where is_cached and track_id is not null), n as (select (select count(*) from perc) as n, (select count(*) from perc where id in (select id from mine)) as m),
  o as (select id, row_number() over (order by id) - 1 as place from perc where id not in (select id from mine))
  select id, true as mine from perc where id in (select id from mine) union all select id, false from o, n where place % greatest(1, (n - m) // greatest(1, 700 - m)) = 0 and place // greatest(1, (n - m) // greatest(1, 700 - m)) < greatest(0, 700 - m)"""
)
def stride_sample(spark: SparkSession, root: str) -> DataFrame:
    """Points of a plot: all of the listener's and every so-many-th other in order of id, 700 at most beside them."""
    from undertone.operators.ranking import running_total

    rows = perc(spark, root).select("id")
    mine = table(spark, root, "dedup_records").where("is_cached and track_id is not null").select(F.col("track_id").alias("id")).distinct().withColumn("mine", F.lit(True))
    marked = rows.join(mine, "id", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    own = marked.where("mine")
    others = running_total(marked.where("not mine").select("id", F.lit(0).alias("g"), F.lit(1).alias("one")), ["g"], "id", "one")
    m = own.agg(F.count("*").alias("m"))
    keep = F.greatest(F.lit(1), 700 - F.col("m"))
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / keep))
    kept = others.join(F.broadcast(m), F.lit(True)).where((F.pmod(F.col("_below"), step) == 0) & (F.floor(F.col("_below") / step) < F.greatest(F.lit(0), 700 - F.col("m"))))
    return own.select("id", "mine").unionByName(kept.select("id", F.lit(False).alias("mine")))


_DIMS = ["energy", "danceability", "acousticness"]


@query(
    f"with {CARD_SQL}, ok as (select * from card where feature_valid), r as (select id, "
    + ", ".join(f"case when {c} is not null then round((rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2.0) / count({c}) over (), 4) end as {c}_pct" for c in _DIMS)
    + f" from ok) select c.id, {', '.join(f'r.{c}_pct' for c in _DIMS)} from card c left join r using (id)"
)
def valid_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentile ranks among the valid tracks only; null for all others."""
    c = card(spark, root).select("id", "feature_valid", *_DIMS)
    shares = average_rank_shares(c.where("feature_valid").select("id", *_DIMS), "id", _DIMS)
    return c.select("id").join(shares, "id", "left").select("id", *[F.round(d, 4).alias(f"{d}_pct") for d in _DIMS])


_ANCHORED = ["tempo_bpm", "rms_mean", "harmonic_ratio"]


@query(
    f"with {FEATS_SQL}, l as (unpivot (select id, {', '.join(_ANCHORED)} from feats) on {', '.join(_ANCHORED)} into name feature value v),"
    + " s as (select feature, min(v) as low, max(v) as high, " + ", ".join(f"quantile_cont(v, {q}) as p{round(q * 100)}" for q in RAW_SHARES) + " from l group by 1),"
    + " a as (select feature, low as a, 0.0 as p from s union all select feature, high, 100.0 from s " + " ".join(f"union all select feature, p{round(q * 100)}, {q * 100:.1f} from s" for q in RAW_SHARES) + "),"
    + """ e as (select l.id, l.feature, l.v, count(*) filter (where a.a = l.v) as tied, min(a.p) filter (where a.a = l.v) as p0, max(a.p) filter (where a.a = l.v) as p1,
    max(a.a) filter (where a.a <= l.v) as a0, max(a.p) filter (where a.a <= l.v) as q0, min(a.a) filter (where a.a >= l.v) as a1, min(a.p) filter (where a.a >= l.v) as q1 from l join a on a.feature = l.feature group by 1, 2, 3),
  ends as (select e.*, s.low, s.high from e join s using (feature))
  select id, feature, cast(case when v <= low then 0 when v >= high then 100 when tied >= 2 then round_even((p0 + p1) / 2, 0) when a1 = a0 then round_even((q0 + q1) / 2, 0) else round_even(q0 + (q1 - q0) * (v - a0) / (a1 - a0), 0) end as integer) as percentile from ends"""
)
def anchored_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Place of each value in its column, interpolated between 15 stored anchors; equal anchors give their middle."""
    long = unpivot(feats(spark, root), ["id"], _ANCHORED).where("value is not null")
    ends = long.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    stats = raw_feature_stats(spark, root, rounded=False).where(F.col("feature").isin(_ANCHORED)).join(ends, "feature")
    points = [F.struct(F.col("low").alias("a"), F.lit(0.0).alias("p")), *[F.struct(F.col(f"p{round(q * 100)}").alias("a"), F.lit(round(q * 100.0, 1)).alias("p")) for q in RAW_SHARES], F.struct(F.col("high").alias("a"), F.lit(100.0).alias("p"))]
    rows = long.join(F.broadcast(stats.select("feature", "low", "high", F.array(*points).alias("anchors"))), "feature")
    v = F.col("value")
    tied, upto, beyond = (F.filter("anchors", f) for f in (lambda x: x["a"] == v, lambda x: x["a"] <= v, lambda x: x["a"] >= v))
    lo, hi = F.array_max(upto), F.array_min(beyond)
    middle = F.bround((F.array_min(tied)["p"] + F.array_max(tied)["p"]) / 2, 0)
    between = F.when(hi["a"] == lo["a"], F.bround((lo["p"] + hi["p"]) / 2, 0)).otherwise(F.bround(lo["p"] + (hi["p"] - lo["p"]) * (v - lo["a"]) / (hi["a"] - lo["a"]), 0))
    place = F.when(v <= F.col("low"), 0.0).when(v >= F.col("high"), 100.0).when(F.size(tied) >= 2, middle).otherwise(between)
    return rows.select("id", "feature", place.cast("int").alias("percentile"))


@query(
    f"""with {TWINS_SQL}, map as (select spotify_track_id as id, duplicate_of as to_id from track_meta where spotify_track_id in (select id from twins)),
  d as (select artist_id, spotify_track_id as id, min(doc_id) as first from documents where artist_id is not null and spotify_track_id is not null group by 1, 2),
  c as (select d.artist_id, coalesce(m.to_id, d.id) as id, min(d.first) as first from d left join map m using (id) group by 1, 2)
  select artist_id, list(id order by first) as ids from c group by 1"""
)
def canonical_lists(spark: SparkSession, root: str) -> DataFrame:
    """Tracks of each list in order of first mention, twins as their canonical track, every track once."""
    mapping = table(spark, root, "track_meta").join(twins(spark, root).withColumnRenamed("id", "spotify_track_id"), "spotify_track_id", "left_semi").select(F.col("spotify_track_id").alias("id"), F.col("duplicate_of").alias("to_id"))
    docs = table(spark, root, "documents").where("artist_id is not null and spotify_track_id is not null")
    d = docs.groupBy("artist_id", F.col("spotify_track_id").alias("id")).agg(F.min("doc_id").alias("first"))
    c = d.join(mapping, "id", "left").groupBy("artist_id", F.coalesce("to_id", "id").alias("id")).agg(F.min("first").alias("first"))
    return c.groupBy("artist_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "id"))), lambda x: x["id"]).alias("ids"))


@query(
    "select spotify_track_id as id, list_distinct(list_filter([trim(artist_names), trim(split_part(artist_names, ',', 1))], lambda x: x <> '')) as variants from track_meta where artist_names is not null and not contains(artist_names, ',') "
    "union all select spotify_track_id, list_filter([trim(artist_names), trim(split_part(artist_names, ',', 1))], lambda x: x <> '') from track_meta where contains(artist_names, ',')"
)
def query_variants(spark: SparkSession, root: str) -> DataFrame:
    """Artist spellings to search by: the whole field, then its first name, without repeats or blanks."""
    a = F.col("artist_names")
    both = F.array(F.trim(a), F.trim(F.split_part(a, F.lit(","), F.lit(1))))
    return table(spark, root, "track_meta").where(a.isNotNull()).select(F.col("spotify_track_id").alias("id"), F.array_distinct(F.filter(both, lambda x: x != "")).alias("variants"))


@query(
    f"""with {FEATS_SQL}, l as (select m.primary_artist_id as artist_id, count(*) as n, median(m.popularity) as middle from track_meta m join feats f on f.id = m.spotify_track_id where m.primary_artist_id is not null and m.popularity is not null group by 1)
  select case when middle < 50 then 'obscure' else 'known' end as stratum, count(*) as n_artists, cast(sum(n) as bigint) as n_tracks from l group by 1"""
)
def popularity_strata(spark: SparkSession, root: str) -> DataFrame:
    """Lists by whether the median popularity of their analysed tracks is under 50."""
    m = table(spark, root, "track_meta").where("primary_artist_id is not null and popularity is not null").select(F.col("spotify_track_id").alias("id"), F.col("primary_artist_id").alias("artist_id"), "popularity")
    counts = m.join(feats(spark, root).select("id"), "id").groupBy("artist_id", "popularity").agg(F.count("*").alias("n"))
    one = counts.groupBy("artist_id").agg(F.sum("n").alias("n"), F.percentile("popularity", F.lit(0.5), F.col("n")).alias("middle"))
    return one.groupBy(F.when(F.col("middle") < 50, "obscure").otherwise("known").alias("stratum")).agg(F.count("*").alias("n_artists"), F.sum("n").alias("n_tracks"))


# Families of extracted columns by the start of their names, first match wins.
FAMILIES = [("mfcc", "timbre"), ("spectral", "spectrum"), ("chroma", "tonality"), ("estimated", "tonality"), ("tempo", "rhythm"), ("beat", "rhythm"), ("onset", "rhythm"), ("rms", "energy"), ("zcr", "texture"), ("harmonic", "texture")]


def _family(name: str) -> str:
    return next((f for start, f in FAMILIES if name.startswith(start)), "other")


@query(f"with {FEATS_SQL}, l as (unpivot (select {', '.join(FEATURES)} from feats) on {', '.join(FEATURES)} into name feature value v), f as (select * from (values " + ", ".join(f"('{c}', '{_family(c)}')" for c in FEATURES) + ") t(feature, family)) select f.feature, f.family, count(l.v) as n from f left join l using (feature) group by 1, 2")
def feature_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """Every extracted column with its family and how many tracks have it."""
    names = spark.createDataFrame([(c, _family(c)) for c in FEATURES], "feature string, family string")
    n = unpivot(feats(spark, root), [], FEATURES).groupBy("feature").agg(F.count("value").alias("n"))
    return names.join(n, "feature", "left").select("feature", "family", F.coalesce("n", F.lit(0)).alias("n"))
