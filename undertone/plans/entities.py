"""Duplicate resolution over the dedup records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.functions.vectors import cosine
from undertone.operators import entities as ops
from undertone.operators.ranking import keep_latest
from undertone.plans.registry import query
from undertone.tables import table

RECORDS_SQL = """rec as (select track_id as id, title, artist, duration_ms, vector, coalesce(is_cached, false) as cached, primary_artist_id as artist_id from dedup_records where track_id is not null
  qualify row_number() over (partition by track_id order by title nulls first, artist nulls first, duration_ms nulls first, is_cached nulls first, primary_artist_id nulls first) = 1)"""
COMP_SQL = """e as (select track_id_a as a, track_id_b as b from match_pairs where accepted and track_id_a <> track_id_b union select track_id_b, track_id_a from match_pairs where accepted and track_id_a <> track_id_b),
walk(id, seen) as (select a, a from e union select e.a, w.seen from e join walk w on w.id = e.b), comp as (select id, min(seen) as component from walk group by 1)"""


def records(spark: SparkSession, root: str) -> DataFrame:
    """Dedup records, one whole row per id: the first by its columns, nulls first."""
    rows = table(spark, root, "dedup_records").where("track_id is not null")
    first = keep_latest(rows, ["track_id"], [F.asc_nulls_first(c) for c in ("title", "artist", "duration_ms", "is_cached", "primary_artist_id", "vector")])
    return first.select(F.col("track_id").alias("id"), "title", "artist", "duration_ms", "vector", F.coalesce("is_cached", F.lit(False)).alias("cached"), F.col("primary_artist_id").alias("artist_id"))


def _links(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "match_pairs").where("accepted and track_id_a <> track_id_b")


@query(f"with recursive {COMP_SQL} select component, count(*) as n from comp group by 1")
def duplicate_groups(spark: SparkSession, root: str) -> DataFrame:
    """Sizes of the transitive closures of accepted pairs."""
    return ops.components(_links(spark, root), "track_id_a", "track_id_b").groupBy("component").agg(F.count("*").alias("n"))


@query(
    f"""with recursive {COMP_SQL}, {RECORDS_SQL}, best as (select component, id as canonical_id from comp join rec using (id)
  qualify row_number() over (partition by component order by not cached, -coalesce(nullif(duration_ms, 0), -1), id) = 1)
  select c.id as duplicate_id, b.canonical_id from comp c join best b using (component) where c.id <> b.canonical_id"""
)
def duplicate_map(spark: SparkSession, root: str) -> DataFrame:
    """Every duplicate with the canonical member of its group."""
    comp = ops.components(_links(spark, root), "track_id_a", "track_id_b").withColumnRenamed("vertex", "id")
    best = ops.canonical_member(comp.join(records(spark, root), "id"), "component", "id", "cached", "duration_ms")
    return comp.join(best, "component").where("id <> canonical_id").select(F.col("id").alias("duplicate_id"), "canonical_id")


_NUM_SQL = "regexp_extract_all(coalesce({t}, ''), '(\\d+)', 1)"


@query(
    f"""with {RECORDS_SQL}, p as (select distinct least(track_id_a, track_id_b) as a, greatest(track_id_a, track_id_b) as b from match_pairs where track_id_a <> track_id_b)
  select p.a, p.b, x.artist_id is not null and y.artist_id is not null and x.artist_id = y.artist_id as same_artist_id,
  coalesce(abs(x.duration_ms - y.duration_ms) <= 7000, true) as within_window, {_NUM_SQL.format(t='x.title')} = {_NUM_SQL.format(t='y.title')} as same_numbering
  from p join rec x on x.id = p.a join rec y on y.id = p.b"""
)
def pair_rules(spark: SparkSession, root: str) -> DataFrame:
    """Rules a candidate pair has to meet, one column each."""
    both = _both(spark, root)
    known = F.col("x.artist_id").isNotNull() & F.col("y.artist_id").isNotNull()
    return both.select(
        "a", "b", (known & F.coalesce(F.col("x.artist_id") == F.col("y.artist_id"), F.lit(False))).alias("same_artist_id"),
        ops.durations_agree(F.col("x.duration_ms"), F.col("y.duration_ms"), F.lit(True)).alias("within_window"), (ops.numbering(F.col("x.title")) == ops.numbering(F.col("y.title"))).alias("same_numbering"),
    )


def _both(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "match_pairs").where("track_id_a <> track_id_b").select(F.least("track_id_a", "track_id_b").alias("a"), F.greatest("track_id_a", "track_id_b").alias("b")).distinct()
    rec = records(spark, root)
    x = rec.select(F.col("id").alias("a"), F.struct(*rec.columns).alias("x"))
    y = rec.select(F.col("id").alias("b"), F.struct(*rec.columns).alias("y"))
    return p.join(x, "a").join(y, "b")


@query(
    f"""with {RECORDS_SQL}, p as (select distinct least(track_id_a, track_id_b) as a, greatest(track_id_a, track_id_b) as b from match_pairs where track_id_a <> track_id_b)
  select p.a, p.b, round(list_cosine_similarity(x.vector, y.vector), 6) as cosine from p join rec x on x.id = p.a join rec y on y.id = p.b
  where x.vector is not null and y.vector is not null and list_cosine_similarity(x.vector, y.vector) < 0.95"""
)
def sound_disagreements(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that matched by text while their vectors differ."""
    both = _both(spark, root).where("x.vector is not null and y.vector is not null")
    return both.withColumn("cosine", cosine(F.col("x.vector"), F.col("y.vector"))).where("cosine < 0.95").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query()
def title_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Records of one title key and version whose artist, duration and sound agree."""
    rec = records(spark, root).withColumn("t", ops.title_keys("title")).select("*", "t.base", "t.version").drop("t").where("base <> ''")
    pairs = _one_artist(rec, ["base", "version"])
    ok = ops.durations_agree(F.col("duration_ms_a"), F.col("duration_ms_b"), F.lit(True)) & ops.sounds_agree(F.col("vector_a"), F.col("vector_b"))
    return pairs.where(ok).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "base", "version")


def _one_artist(rec: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of records with equal keys and one artist: equal ids, or equal leading names where an id is unknown.

    The artist is part of either join's key, so a title or a length that many
    artists use never gathers their records in one group.
    """
    named = rec.withColumn("lead", ops.leading_artist(F.col("artist")))
    other = [c for c in named.columns if c not in keys]

    def side(rows: DataFrame, s: str, key: str) -> DataFrame:
        return rows.select(*keys, F.col(key).alias("_k"), *[F.col(c).alias(f"{c}_{s}") for c in other])

    by_id = named.where("artist_id is not null")
    same_id = side(by_id, "a", "artist_id").join(side(by_id, "b", "artist_id"), [*keys, "_k"])
    by_name = named.where("lead <> ''")
    same_name = side(by_name, "a", "lead").join(side(by_name, "b", "lead"), [*keys, "_k"]).where("artist_id_a is null or artist_id_b is null")
    return same_id.unionByName(same_name).where("id_a < id_b").drop("_k")


@query()
def duration_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Records of equal duration, version and numbering whose titles are alike."""
    rec = records(spark, root).where("duration_ms > 0").withColumn("t", ops.title_keys("title")).select("id", "duration_ms", "artist_id", "artist", "t.base", "t.version", ops.numbering(F.col("title")).alias("digits"))
    pairs = _one_artist(rec, ["duration_ms", "version", "digits"])
    # The ratio cannot exceed what the shorter text matches in full, so far lengths need no alignment.
    near = F.least(F.length("base_a"), F.length("base_b")) * 2 >= 0.8 * (F.length("base_a") + F.length("base_b"))
    return pairs.where(near).withColumn("ratio", ops.ratio("base_a", "base_b")).where("ratio >= 0.8").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round("ratio", 6).alias("ratio"))


@query(
    "select spotify_track_id as id, trim(regexp_replace(strip_accents(lower(trim(split_part(artist_names, ',', 1)))), '[^\\p{L}\\p{N}]+', ' ', 'g')) as artist from track_meta where artist_names is not null"
)
def folded_artists(spark: SparkSession, root: str) -> DataFrame:
    """Leading comma part of the artist field without case, accents and punctuation."""
    from undertone.functions.text import squeeze

    first = F.trim(F.split_part("artist_names", F.lit(","), F.lit(1)))
    return table(spark, root, "track_meta").where("artist_names is not null").select(F.col("spotify_track_id").alias("id"), squeeze(first).alias("artist"))


@query(
    """with d as (select spotify_track_id as id, track_name, case when duplicate_of is not null and trim(duplicate_of) <> '' and duplicate_of <> spotify_track_id then duplicate_of end as twin_of from track_meta),
  alts as (select twin_of as id, array_to_string(list_sort(list(coalesce(track_name, ''))), '|') as alt_names, count(*) as n from d where twin_of is not null group by 1)
  select d.id, coalesce(a.alt_names, '') as alt_names, 1 + coalesce(a.n, 0) as n_versions from d left join alts a using (id) where d.twin_of is null or d.twin_of not in (select id from d)"""
)
def twin_collapse(spark: SparkSession, root: str) -> DataFrame:
    """Library without twins; the canonical row carries the names of its twins."""
    twin = F.when(F.col("duplicate_of").isNotNull() & (F.trim("duplicate_of") != "") & (F.col("duplicate_of") != F.col("spotify_track_id")), F.col("duplicate_of"))
    d = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), "track_name", twin.alias("twin_of"))
    alts = d.where("twin_of is not null").groupBy(F.col("twin_of").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("track_name", F.lit("")))), "|").alias("alt_names"), F.count("*").alias("n"))
    hidden = d.where("twin_of is not null").select("id", "twin_of").join(d.select(F.col("id").alias("twin_of")), "twin_of", "left_semi").select("id")
    rows = d.join(hidden, "id", "left_anti").join(alts, "id", "left")
    return rows.select("id", F.coalesce("alt_names", F.lit("")).alias("alt_names"), (1 + F.coalesce("n", F.lit(0))).alias("n_versions"))


@query(
    """with m as (select cluster_key, canonical_id, list_sort(list_distinct(members)) as ids from duplicate_clusters) select cluster_key, len(ids) as n_members, ids[1] as first_member, list_contains(ids, canonical_id) as has_canonical from m"""
)
def cluster_members(spark: SparkSession, root: str) -> DataFrame:
    """Distinct members of the reported groups."""
    ids = F.array_sort(F.array_distinct("members"))
    return table(spark, root, "duplicate_clusters").select("cluster_key", F.size(ids).cast("long").alias("n_members"), ids[0].alias("first_member"), F.array_contains(ids, F.col("canonical_id")).alias("has_canonical"))
