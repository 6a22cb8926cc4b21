"""Listening windows: fact table, centroids and taste drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.operators.aggregates import banded, centroids, sigma_shift, unpivot
from undertone.operators.ranking import top_per_group
from undertone.plans.base import FEATS_SQL, FEATURES, LISTEN_SQL, SIMILARITY, feats, listen, ranked_listen
from undertone.plans.registry import query
from undertone.tables import table

DRIFT = [c for c in FEATURES if c in SIMILARITY[:8]] + ["onset_strength_std", "beats_per_sec"]
BANDS = [(0.15, "stable"), (0.35, "gentle"), (0.60, "clear")]
_AVG = ", ".join(f"avg({c}) as {c}" for c in DRIFT)
FACT_SQL = f"""with {LISTEN_SQL}, {FEATS_SQL},
fact as (select l.time_range, l.range_order, l.id, l.rank, l.plays, {", ".join("f." + c for c in DRIFT)} from listen l left join feats f on f.id = l.id)"""


def fact(spark: SparkSession, root: str, ranked: bool = False) -> DataFrame:
    """Fact at the grain (track, window): features stay null where never extracted; ranks only where asked for."""
    return (ranked_listen if ranked else listen)(spark, root).join(feats(spark, root).select("id", *DRIFT), "id", "left")


@query(f"{FACT_SQL} select time_range, id, rank, round(tempo_bpm, 9) as tempo_bpm, round(rms_mean, 9) as rms_mean from fact")
def fact_listening(spark: SparkSession, root: str) -> DataFrame:
    rows = ranked_listen(spark, root).join(feats(spark, root).select("id", "tempo_bpm", "rms_mean"), "id", "left")
    return rows.select("time_range", "id", "rank", F.round("tempo_bpm", 9).alias("tempo_bpm"), F.round("rms_mean", 9).alias("rms_mean"))


@query(
    f"{FACT_SQL} select time_range, count(*) as track_count, "
    + ", ".join(f"round(avg({c}), 9) as {c}, round(stddev_samp({c}), 9) as {c}_std_within" for c in DRIFT)
    + " from fact group by 1"
)
def window_centroids(spark: SparkSession, root: str) -> DataFrame:
    rows = centroids(fact(spark, root), ["time_range"], DRIFT, spread=True)
    return rows.select("time_range", "track_count", *[F.round(c, 9).alias(c) for d in DRIFT for c in (d, f"{d}_std_within")])


_SHIFT_SQL = (
    f"{FACT_SQL}, st as (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in DRIFT)
    + f" from fact), cen as (select time_range, {_AVG} from fact group by 1), z as (select time_range, "
    + ", ".join(f"cast(cast(case when s_{c} > 1e-12 then ({c} - m_{c}) / s_{c} when {c} is not null then 0 end as float) as double) as {c}" for c in DRIFT)
    + " from cen, st), pairs as (select a.time_range as range_a, b.time_range as range_b, sqrt(("
    + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in DRIFT)
    + f") / {len(DRIFT)}) as shift from z a join z b on a.time_range <> b.time_range)"
)


@query(
    _SHIFT_SQL
    + """ select range_a, range_b, round(shift, 5) as shift,
  case when shift < 0.15 then 'stable' when shift < 0.35 then 'gentle' when shift < 0.6 then 'clear' else 'strong' end as label
  from pairs where (range_a, range_b) in (('short_term', 'medium_term'), ('medium_term', 'long_term'), ('short_term', 'long_term'))"""
)
def taste_drift(spark: SparkSession, root: str) -> DataFrame:
    """Shift in sample deviations between the three fixed pairs of windows."""
    pairs = sigma_shift(fact(spark, root), "time_range", DRIFT)
    wanted = F.concat_ws(">", "group_a", "group_b").isin("short_term>medium_term", "medium_term>long_term", "short_term>long_term")
    return pairs.where(wanted).select(F.col("group_a").alias("range_a"), F.col("group_b").alias("range_b"), F.round("shift", 5).alias("shift"), banded(F.col("shift"), BANDS, "strong").alias("label"))


@query(
    _SHIFT_SQL
    + """ select round(coalesce(max(case when range_a = 'short_term' and range_b = 'long_term' then shift end), 0), 5) as drift_score,
  round(coalesce(1 - least(avg(shift), 1), 1), 5) as stability from pairs
  where (range_a, range_b) in (('short_term', 'medium_term'), ('medium_term', 'long_term'), ('short_term', 'long_term'))"""
)
def drift_score(spark: SparkSession, root: str) -> DataFrame:
    pairs = sigma_shift(fact(spark, root), "time_range", DRIFT)
    wanted = F.concat_ws(">", "group_a", "group_b").isin("short_term>medium_term", "medium_term>long_term", "short_term>long_term")
    headline = F.max(F.when((F.col("group_a") == "short_term") & (F.col("group_b") == "long_term"), F.col("shift")))
    return pairs.where(wanted).agg(
        F.round(F.coalesce(headline, F.lit(0.0)), 5).alias("drift_score"), F.round(F.coalesce(1 - F.least(F.avg("shift"), F.lit(1.0)), F.lit(1.0)), 5).alias("stability")
    )


@query(
    f"{FACT_SQL}, cen as (select time_range, {_AVG} from fact group by 1) select a.time_range as range_a, b.time_range as range_b, round(1 - greatest(-1, least(1, ("
    + " + ".join(f"a.{c} * b.{c}" for c in DRIFT) + ") / (sqrt(" + " + ".join(f"a.{c} * a.{c}" for c in DRIFT) + ") * sqrt(" + " + ".join(f"b.{c} * b.{c}" for c in DRIFT)
    + ")))), 8) as distance from cen a join cen b on a.time_range < b.time_range"
)
def cosine_drift(spark: SparkSession, root: str) -> DataFrame:
    """Cosine distance of raw centroids, the older drift metric; 1 where a centroid has no length."""
    from undertone.functions.vectors import dot, norm

    c = centroids(fact(spark, root), ["time_range"], DRIFT).select("time_range", F.array(*DRIFT).alias("v"))
    a, b = c.select(F.col("time_range").alias("range_a"), F.col("v").alias("va")), c.select(F.col("time_range").alias("range_b"), F.col("v").alias("vb"))
    size = norm(F.col("va")) * norm(F.col("vb"))
    near = F.when(size > 1e-8, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("va"), F.col("vb")) / size))).otherwise(0.0)
    return a.join(b, F.col("range_a") < F.col("range_b")).select("range_a", "range_b", F.round(1 - near, 8).alias("distance"))


@query(
    f"{FACT_SQL}, cen as (select time_range, {_AVG} from fact group by 1), longer as (unpivot cen on {', '.join(DRIFT)} into name feature value v)"
    """, w as (select feature, max(case when time_range = 'short_term' then v end) as s, max(case when time_range = 'long_term' then v end) as l from longer group by 1)
  select feature, round(s - l, 4) as delta, round(100 * (s - l) / greatest(abs(l), 1e-8), 2) as delta_pct,
    case when s > l * 1.02 then 'up' when s < l * 0.98 then 'down' else 'flat' end as direction from w"""
)
def feature_deltas(spark: SparkSession, root: str) -> DataFrame:
    """Short against long window per feature, absolute and relative."""
    c = unpivot(centroids(fact(spark, root), ["time_range"], DRIFT), ["time_range"], DRIFT, "feature", "v")
    w = c.groupBy("feature").agg(F.max(F.when(F.col("time_range") == "short_term", F.col("v"))).alias("s"), F.max(F.when(F.col("time_range") == "long_term", F.col("v"))).alias("l"))
    gap = F.col("s") - F.col("l")
    return w.select(
        "feature", F.round(gap, 4).alias("delta"), F.round(100 * gap / F.greatest(F.abs("l"), F.lit(1e-8)), 2).alias("delta_pct"),
        F.when(F.col("s") > F.col("l") * 1.02, "up").when(F.col("s") < F.col("l") * 0.98, "down").otherwise("flat").alias("direction"),
    )


@query(
    f"""{FACT_SQL} select count(*) as n_rows, count(distinct f.id) as n_tracks, count(distinct case when rms_mean is not null then f.id end) as n_with_features,
  count(distinct m.primary_artist_id) as n_artists, array_to_string(list_sort(list_distinct(list(time_range))), ',') as ranges from fact f left join track_meta m on m.spotify_track_id = f.id"""
)
def corpus_counts(spark: SparkSession, root: str) -> DataFrame:
    meta = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), "primary_artist_id")
    return fact(spark, root).join(meta, "id", "left").agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_tracks"), F.count_distinct(F.when(F.col("rms_mean").isNotNull(), F.col("id"))).alias("n_with_features"),
        F.count_distinct("primary_artist_id").alias("n_artists"), F.array_join(F.array_sort(F.collect_set("time_range")), ",").alias("ranges"),
    )


@query(
    f"{FACT_SQL}, t as (select id, count(distinct time_range) as n_ranges, avg(rank) as avg_rank from fact group by 1) select n_ranges, count(*) as n_tracks, round(min(avg_rank), 9) as best_avg_rank from t group by 1"
)
def persistence(spark: SparkSession, root: str) -> DataFrame:
    t = fact(spark, root, ranked=True).groupBy("id").agg(F.count_distinct("time_range").alias("n_ranges"), F.avg("rank").alias("avg_rank"))
    return t.groupBy("n_ranges").agg(F.count("*").alias("n_tracks"), F.round(F.min("avg_rank"), 9).alias("best_avg_rank"))


@query(
    f"{FACT_SQL}, t as (select id, count(distinct time_range) as n_ranges, avg(rank) as avg_rank from fact group by 1) select id, round(avg_rank, 9) as avg_rank from t where n_ranges = 3 order by t.avg_rank, id limit 5"
)
def persistent_top(spark: SparkSession, root: str) -> DataFrame:
    t = fact(spark, root, ranked=True).groupBy("id").agg(F.count_distinct("time_range").alias("n_ranges"), F.avg("rank").alias("avg_rank"))
    return t.where("n_ranges = 3").orderBy("avg_rank", "id").limit(5).select("id", F.round("avg_rank", 9).alias("avg_rank"))


_SUPER = ["tempo_bpm", "rms_mean", "harmonic_ratio", "onset_strength_mean"]


@query(
    f"{FACT_SQL}, l as (unpivot (select time_range, id, {', '.join(_SUPER)} from fact) on {', '.join(_SUPER)} into name feature value v) "
    "select time_range, feature, id, round(v, 9) as value from l qualify row_number() over (partition by time_range, feature order by v desc, id) = 1"
)
def superlatives(spark: SparkSession, root: str) -> DataFrame:
    """The extreme track of every window for four features; ties go to the smaller id."""
    long = unpivot(fact(spark, root), ["time_range", "id"], _SUPER).where("value is not null")
    best = long.groupBy("time_range", "feature").agg(F.min(F.struct((-F.col("value")).alias("minus"), "id")).alias("b"))
    return best.select("time_range", "feature", F.col("b.id").alias("id"), F.round(-F.col("b.minus"), 9).alias("value"))


@query(f"{FACT_SQL} select time_range, rank, id from fact where rank <= 10")
def top_by_window(spark: SparkSession, root: str) -> DataFrame:
    return top_per_group(listen(spark, root), ["time_range"], [F.desc("plays"), F.col("id")], 10).select("time_range", F.col("rank").cast("long").alias("rank"), "id")


@query(f"{FACT_SQL} select time_range, round(avg(tempo_bpm), 9) as tempo, round(avg(rms_mean), 9) as rms, count(*) as n from fact group by 1")
def window_strip(spark: SparkSession, root: str) -> DataFrame:
    return fact(spark, root).groupBy("time_range").agg(F.round(F.avg("tempo_bpm"), 9).alias("tempo"), F.round(F.avg("rms_mean"), 9).alias("rms"), F.count("*").alias("n"))


_COMPOSE_SQL = f"""with {LISTEN_SQL}, mx as (select max(model_id) as m from track_clusters),
lab as (select spotify_track_id as id, min(cluster_id) as cluster_id from track_clusters, mx where model_id = m and cluster_id is not null group by 1),
n as (select time_range, cluster_id, count(*) as n_tracks from listen join lab using (id) group by 1, 2)"""


@query(f"{_COMPOSE_SQL} select time_range, cluster_id, n_tracks, round(n_tracks / sum(n_tracks) over (partition by time_range), 9) as share from n")
def cluster_composition(spark: SparkSession, root: str) -> DataFrame:
    """Share of every cluster in each window."""
    return _composition(spark, root)


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    """Listened tracks with their cluster under the newest model."""
    clusters = table(spark, root, "track_clusters")
    newest = clusters.agg(F.max("model_id").alias("m"))
    labels = clusters.where("cluster_id is not null").join(F.broadcast(newest), F.col("model_id") == F.col("m")).groupBy(F.col("spotify_track_id").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    return listen(spark, root).join(labels, "id")


def _composition(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    n = _labelled(spark, root).groupBy("time_range", "cluster_id").agg(F.count("*").alias("n_tracks"))
    return n.withColumn("share", F.round(F.col("n_tracks") / F.sum("n_tracks").over(Window.partitionBy("time_range")), 9))


@query(
    f"""{_SHIFT_SQL}, mx as (select max(model_id) as m from track_clusters), lab as (select spotify_track_id as id, min(cluster_id) as cluster_id from track_clusters, mx where model_id = m and cluster_id is not null group by 1),
  c as (select cluster_id, count(*) as n from listen join lab using (id) group by 1), k as (select *, row_number() over (order by n desc, cluster_id) as k, sum(n) over () as whole from c),
  r as (select max(cluster_id) filter (where k = 1) as home, max(n) filter (where k = 1) / max(whole) as top, sum(n) filter (where k <= 2) / max(whole) as two, count(*) as sounds from k),
  d as (select shift from pairs where range_a = 'short_term' and range_b = 'long_term')
  select home, round(top, 6) as share, case when top >= 0.7 or sounds = 1 then 'Loyalist' when two >= 0.85 then 'Dualist' else 'Eclectic' end as breadth,
  case when shift < 0.15 then 'Anchored' when shift < 0.35 then 'Drifting' when shift < 0.6 then 'Roaming' when shift is not null then 'Shape-shifting' end as motion from r left join d on true"""
)
def archetype(spark: SparkSession, root: str) -> DataFrame:
    """Breadth of the listening over the sounds of all windows, its home, and how far it moved from all-time to recent."""
    c = _labelled(spark, root).groupBy("cluster_id").agg(F.count("*").alias("n"))
    # One row per cluster of a trained model.
    ordered = c.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("lack"), "cluster_id"))).alias("c"), F.sum("n").alias("whole")).where(F.size("c") > 0)
    share = [-F.get("c", F.lit(i))["lack"] / F.col("whole") for i in (0, 1)]
    top, two = share[0], share[0] + F.coalesce(share[1], F.lit(0.0))
    r = ordered.select(F.col("c")[0]["cluster_id"].alias("home"), top.alias("top"), two.alias("two"), F.size("c").alias("sounds"))
    moved = sigma_shift(fact(spark, root), "time_range", DRIFT).where("group_a = 'short_term' and group_b = 'long_term'").select("shift")
    motion = F.when(F.col("shift").isNotNull(), banded(F.col("shift"), [(0.15, "Anchored"), (0.35, "Drifting"), (0.60, "Roaming")], "Shape-shifting"))
    breadth = F.when((F.col("top") >= 0.7) | (F.col("sounds") == 1), "Loyalist").when(F.col("two") >= 0.85, "Dualist").otherwise("Eclectic")
    return r.join(F.broadcast(moved), F.lit(True), "left").select("home", F.round("top", 6).alias("share"), breadth.alias("breadth"), motion.alias("motion"))