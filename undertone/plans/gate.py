"""Candidates against the wanted recordings: the match gate, its choice, and the review of what was taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.functions import matching as m
from undertone.plans.registry import query
from undertone.tables import table

# Reasons of a refusal in the order of the tests, and the strata of the review.
REASONS = [("copy", "reproduction"), ("not contained", "title"), ("not affinity", "artist"), ("mismatch", "length"), ("implausible", "version")]
STRATA = [("review", 12), ("title_present", 5), ("verified", 3), ("owner", 0)]
RECALL = 0.6

_MARKS = ", ".join("'" + r + "'" for r in m.REPRODUCTIONS)
GATE_SQL = f"""cand as (select distinct r.track_id as id, r.title, r.artist as channel, r.duration_ms / 1000.0 as sec, coalesce(t.track_name, '') as name, t.track_name is null as nameless, t.artist_names as artist, t.duration_ms / 1000.0 as want
  from dedup_records r join track_meta t on t.spotify_track_id = r.track_id),
worded as (select *, {m.sql_squash(m.sql_core('name'))} as core, {m.sql_squash('title')} as whole, {m.sql_tokens(m.sql_core('name'))} as want_t, {m.sql_tokens('title')} as have_t,
  {m.sql_tokens('artist')} as who, {m.sql_tokens('channel')} as chan, {m.sql_tokens(m.sql_head("coalesce(title, '')"))} as lead, abs(sec - want) as gap from cand),
judged as (select id, title, nameless, len(core) >= 2 and contains(whole, core) as contained,
  case when len(want_t) = 0 then 0.0 else len(list_filter(want_t, lambda w: list_contains(have_t, w) or (len(w) >= 4 and contains(whole, w)))) / len(want_t) end as recall,
  list_has_any(who, chan) or list_has_any(who, lead) as affinity,
  len(list_filter([{_MARKS}], lambda w: contains(' ' || lower(coalesce(title, '')) || ' | ' || lower(coalesce(channel, '')) || ' ', w))) > 0 as copy,
  not (coalesce(sec, 0) > 0 and coalesce(want, 0) > 0) or gap > greatest(20, 0.15 * want) as mismatch,
  coalesce(sec > 0 and sec > case when coalesce(want, 0) > 0 then greatest(2 * want, want + 120) else {m.LONGEST_TRACK_SEC} end, false) as implausible,
  cast({m.sql_score('title', 'gap')} as integer) as score from worded),
gate as (select *, not copy and contained and affinity and not mismatch and not implausible as confident from judged)"""
_REASON_SQL = "case " + " ".join(f"when {test} then '{name}'" for test, name in REASONS) + " end"


def gate(spark: SparkSession, root: str) -> DataFrame:
    """Every candidate title of a track with the tests it passes; all of them make it confident."""
    r = table(spark, root, "dedup_records").select(F.col("track_id").alias("id"), "title", F.col("artist").alias("channel"), (F.col("duration_ms") / 1000.0).alias("sec")).distinct()
    t = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("id"), F.col("track_name").alias("name"), F.col("artist_names").alias("artist"), (F.col("duration_ms") / 1000.0).alias("want"))
    name, title, channel, sec, want = (F.col(c) for c in ("name", "title", "channel", "sec", "want"))
    tests = r.join(t, "id").select(
        "id", "title", name.isNull().alias("nameless"), m.contains_title(name, title).alias("contained"), m.recall(name, title).alias("recall"), m.performed_by(F.col("artist"), title, channel).alias("affinity"),
        m.reproduction(title, channel).alias("copy"), m.other_length(sec, want).alias("mismatch"), m.too_long(sec, want).alias("implausible"), m.score(title, sec, want).alias("score"),
    )
    return tests.withColumn("confident", F.expr("not copy and contained and affinity and not mismatch and not implausible"))


@query(f"with {GATE_SQL} select id, title, contained, round(recall, 6) as recall, affinity, copy, mismatch, implausible, confident, {_REASON_SQL} as reason from gate")
def match_gate(spark: SparkSession, root: str) -> DataFrame:
    """Tests of every candidate and the first that refuses it; nothing refuses a confident one."""
    reason = F.expr(_REASON_SQL)
    return gate(spark, root).select("id", "title", "contained", F.round("recall", 6).alias("recall"), "affinity", "copy", "mismatch", "implausible", "confident", reason.alias("reason"))


@query(f"with {GATE_SQL} select id, arg_max(title, (score, title)) as title, max(score) as score, round(greatest(0, least(1, (max(score) + 30) / 65.0)), 6) as confidence from gate where confident group by 1")
def confident_choice(spark: SparkSession, root: str) -> DataFrame:
    """The best of the candidates that pass: first the filter, then the rank; ties by title."""
    ok = gate(spark, root).where("confident")
    best = ok.groupBy("id").agg(F.max_by("title", F.struct("score", "title")).alias("title"), F.max("score").alias("score"))
    return best.select("id", "title", "score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 30) / 65.0)), 6).alias("confidence"))


_TIERS_SQL = f"""{GATE_SQL},
src as (select spotify_track_id as id, arg_max(extraction_source, (extracted_at, extraction_source)) as source from track_features where spotify_track_id is not null and extracted_at is not null group by 1),
tiers as (select g.id, case when bool_or(s.source = 'upload') then 'owner' when bool_or(g.nameless) then 'review' when bool_or(g.confident) then 'verified' when max(g.recall) >= {RECALL} then 'title_present' else 'review' end as tier
  from gate g join src s using (id) group by 1)"""


def tiers(spark: SparkSession, root: str) -> DataFrame:
    """Trust in what was taken for each track: the owner's own, verified, recognisable by title, or to review."""
    taken = table(spark, root, "track_features").where("spotify_track_id is not null and extracted_at is not null").groupBy(F.col("spotify_track_id").alias("id"))
    source = taken.agg(F.max_by("extraction_source", F.struct("extracted_at", "extraction_source")).alias("source"))
    g = gate(spark, root).join(source, "id").groupBy("id").agg(F.bool_or(F.col("source") == "upload").alias("own"), F.bool_or("nameless").alias("nameless"), F.bool_or("confident").alias("ok"), F.max("recall").alias("recall"))
    return g.select("id", F.when(F.col("own"), "owner").when(F.col("nameless"), "review").when(F.col("ok"), "verified").when(F.col("recall") >= RECALL, "title_present").otherwise("review").alias("tier"))


@query(f"with {_TIERS_SQL} select tier, count(*) as n from tiers group by 1")
def provenance_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Tracks per tier of trust."""
    return tiers(spark, root).groupBy("tier").agg(F.count("*").alias("n"))


_QUOTA_SQL = "case tier " + " ".join(f"when '{t}' then {n}" for t, n in STRATA) + " end"
_ORDER_SQL = "case tier " + " ".join(f"when '{t}' then {i}" for i, (t, _) in enumerate(STRATA)) + " end"


@query(f"with {_TIERS_SQL}, k as (select *, row_number() over (partition by tier order by id) as k from tiers) select id, tier from k order by k > {_QUOTA_SQL}, {_ORDER_SQL}, k limit 20")
def review_sample(spark: SparkSession, root: str) -> DataFrame:
    """Twenty tracks to review: the quota of each tier in order of id, free places to the least trusted tiers."""
    first = tiers(spark, root).withColumn("k", F.row_number().over(Window.partitionBy("tier").orderBy("id"))).where("k <= 20")
    return first.orderBy(F.expr(f"k > {_QUOTA_SQL}"), F.expr(_ORDER_SQL), "k").limit(20).select("id", "tier")


@query(f"with {GATE_SQL} select id, score, round(greatest(0, least(1, (score + 30) / 65.0)), 6) as confidence from gate")
def match_scores(spark: SparkSession, root: str) -> DataFrame:
    """Candidates scored by words of their title and bands of the difference in length."""
    return gate(spark, root).select("id", "score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 30) / 65.0)), 6).alias("confidence"))


@query(f"with {GATE_SQL} select id, max(copy) as copy from gate group by 1")
def reproductions(spark: SparkSession, root: str) -> DataFrame:
    """Records whose title or channel marks a reproduction."""
    return gate(spark, root).groupBy("id").agg(F.max("copy").alias("copy"))


@query(f"with {GATE_SQL} select count(*) filter (where implausible) as implausible, count(*) filter (where recall < 0.5) as title_far, count(*) filter (where not confident) as refused, count(*) as n from gate")
def gate_sweep(spark: SparkSession, root: str) -> DataFrame:
    """How many candidates each check of the quality sweep would quarantine."""
    c = F.count_if
    return gate(spark, root).agg(c("implausible").alias("implausible"), c(F.col("recall") < 0.5).alias("title_far"), c(~F.col("confident")).alias("refused"), F.count("*").alias("n"))
