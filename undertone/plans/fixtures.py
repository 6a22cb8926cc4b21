"""Plans over small fixed tables, for columns that no data table has: chat logs, labels, jobs, sections, playlists."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.functions.curves import sections
from undertone.operators import jobs as queue
from undertone.plans.registry import query


class Fixture:
    """Rows that Spark and SQL read alike."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [(c.split()[0], c.split()[1]) for c in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self, name: str) -> str:
        kinds = {"string": "varchar", "int": "integer", "long": "bigint", "double": "double", "boolean": "boolean", "timestamp_ntz": "timestamp", "array<string>": "varchar[]"}

        def text(v) -> str:
            if v is None:
                return "null"
            if isinstance(v, list):
                return "[" + ", ".join(map(text, v)) + "]"
            return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

        body = ", ".join("(" + ", ".join(f"cast({text(v)} as {kinds[k]})" for v, (_, k) in zip(r, self.columns)) + ")" for r in self.rows)
        return f"{name} as (select * from (values {body}) t({', '.join(c for c, _ in self.columns)}))"


def _at(minute: int) -> datetime.datetime:
    return datetime.datetime(2026, 1, 5, 10, 0) + datetime.timedelta(minutes=minute)


TURNS = Fixture(
    "id long, source string, mode string, latency double, made_at timestamp_ntz",
    [
        (i, ("llm", "fallback", None)[i % 7 % 3], ("story", "adhoc", "cluster")[i % 3], (None, 0.0, 12.5, 840.0, -1.0)[i % 5], _at((i * 37) % 90))
        for i in range(45)
    ],
)
LABELS = Fixture(
    "id long, mode string, source string, accuracy int, citation_fidelity int, usefulness int, invention boolean, verdict string",
    [(i, ("story", "adhoc")[i % 2], ("llm", "fallback")[i % 3 // 2], (2, 1, 2, None)[i % 4], (2, 2, None, 0)[i % 5 % 4], i % 3, i % 6 == 5, ("keep", "drop", None)[i % 4 % 3]) for i in range(40)],
)
ANSWERS = Fixture(
    "id long, cited array<string>, grounding string, answer string, must_cite array<string>, must_not array<string>, kind string",
    [
        (1, ["Amber Kite", "Zed"], "artists: amber kite, ZED MARUN", "Amber Kite plays with Zed.", ["amber"], ["oslo"], "taste"),
        (2, ["Oslo"], "artists: amber kite", "Oslo is not in the data.", ["kite"], ["oslo"], "taste"),
        (3, [], "artists: none", "Nothing to cite.", [], [], "clusters"),
        (4, ["Kite", "Nobody"], "Amber Kite", "amber kite", ["kite", "amber"], ["nobody"], "clusters"),
        (5, ["Kite"], "Amber Kite", "No name here", ["kite"], [], "injection"),
        (6, None, None, None, ["x"], ["y"], "injection"),
    ],
)
JOBS = Fixture(
    "id string, status string, requested_at timestamp_ntz, attempts int, reason string",
    [(f"j{i:02}", ("queued", "running", "failed", "done", "queued")[i % 5], _at((i * 53) % 71), i % 5 % 4, None if i % 2 else "no source") for i in range(24)],
)
LISTS = Fixture(
    "list_id string, owner string, collaborative boolean",
    [("p1", "me", False), ("p2", "you", True), ("p3", "you", False), ("p4", None, None), ("p5", "me", None), ("p6", None, True)],
)


def _section_rows() -> list[tuple]:
    import json

    rows = []
    for t in range(12):
        n = 70 if t == 3 else 3 + t
        parts = [{"start": 7.25 * i, "end": 7.25 * i + (0.5 if i % 5 == 4 else 6.4 + i / 8), "label": i % 3, "tempo_bpm": 100.25 + 3 * i, "loudness_db": -9.5 - i % 4, "key": (t * i) % 3 if t % 4 else 5, "mode": ("major", "minor")[i * t % 2]} for i in range(n)]
        rows.append((f"s{t:02}", json.dumps(parts)))
    return [*rows, ("s90", "not json"), ("s91", None), ("s92", "[]"), ("s93", '{"start": 1}')]


SECTIONS = Fixture("id string, sections string", _section_rows())


_REAL = "not (coalesce(source = 'llm' and (latency is null or latency <= 0), false))"


@query(f"with {TURNS.sql('turns')} select id, source, mode from turns where {_REAL} order by made_at desc, id limit 20")
def real_turns(spark: SparkSession, root: str) -> DataFrame:
    """The newest 20 turns that are no synthetic ones; turns of unknown source stay."""
    return TURNS.frame(spark).where(_REAL).orderBy(F.desc("made_at"), "id").limit(20).select("id", "source", "mode")


@query(
    f"""with {TURNS.sql('turns')}, s as (select *, case when mode = 'story' and source = 'llm' then 1 when mode = 'adhoc' and source = 'llm' then 2 when source = 'fallback' then 3 end as stratum from turns),
  k as (select *, row_number() over (partition by stratum order by made_at desc, id) as k from s), q as (select *, stratum is not null and k <= case stratum when 3 then 2 else 4 end as chosen from k)
  select id, mode, source, chosen from q order by not chosen, case when chosen then stratum end, made_at desc, id limit 16"""
)
def stratified_turns(spark: SparkSession, root: str) -> DataFrame:
    """Sixteen turns to grade: the newest of each stratum up to its quota, free places to the newest of the rest."""
    stratum = F.expr("case when mode = 'story' and source = 'llm' then 1 when mode = 'adhoc' and source = 'llm' then 2 when source = 'fallback' then 3 end")
    k = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("made_at"), "id"))
    rows = TURNS.frame(spark).withColumn("stratum", stratum).withColumn("k", k).withColumn("chosen", F.expr("stratum is not null and k <= case stratum when 3 then 2 else 4 end"))
    return rows.orderBy(~F.col("chosen"), F.when(F.col("chosen"), F.col("stratum")), F.desc("made_at"), "id").limit(16).select("id", "mode", "source", "chosen")


@query(
    f"""with {LABELS.sql('labels')} select mode, source, count(*) as n, round(avg(accuracy), 2) as accuracy, round(avg(citation_fidelity), 2) as citation_fidelity, round(avg(usefulness), 2) as usefulness,
  count(*) filter (where invention) as inventions, count(*) filter (where accuracy = 2 and citation_fidelity = 2 and not coalesce(invention, false)) as eligible, count(*) filter (where verdict = 'keep') as keep, count(*) filter (where verdict = 'drop') as dropped
  from labels group by grouping sets ((mode, source), ())"""
)
def label_report(spark: SparkSession, root: str) -> DataFrame:
    """Means, inventions and verdicts of graded turns by mode and source, with the row of all."""
    mean = {c: F.round(F.avg(c), 2).alias(c) for c in ("accuracy", "citation_fidelity", "usefulness")}
    aggs = [F.count("*").alias("n"), *mean.values(), F.count_if("invention").alias("inventions"), F.count_if(F.expr("accuracy = 2 and citation_fidelity = 2 and not coalesce(invention, false)")).alias("eligible"), F.count_if(F.col("verdict") == "keep").alias("keep"), F.count_if(F.col("verdict") == "drop").alias("dropped")]
    labels = LABELS.frame(spark)
    return labels.groupBy("mode", "source").agg(*aggs).unionByName(labels.agg(*aggs), allowMissingColumns=True)


_VERIFIED = "list_filter(cited, lambda c: contains(lower(coalesce(grounding, '')), lower(c)))"


@query(
    f"""with {ANSWERS.sql('answers')}, v as (select *, {_VERIFIED} as verified from answers), w as (select *, list_filter(verified, lambda c: not contains(lower(coalesce(answer, '')), lower(c))) as missing from v)
  select id, len(cited) as n_cited, len(verified) as n_verified, len(missing) as n_unsaid,
  case when coalesce(len(cited), 0) = 0 then null when len(verified) = len(cited) and len(missing) = 0 then 2 when len(verified) > 0 then 1 else 0 end as fidelity, coalesce(len(cited) > len(verified), false) as invention from w"""
)
def citation_check(spark: SparkSession, root: str) -> DataFrame:
    """Citations that the data hold, those of them the answer does not say, and the grade both suggest."""
    verified = F.filter("cited", lambda c: F.contains(F.lower(F.coalesce("grounding", F.lit(""))), F.lower(c)))
    rows = ANSWERS.frame(spark).withColumn("verified", verified)
    rows = rows.withColumn("missing", F.filter("verified", lambda c: ~F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(c))))
    n, v, u = (F.array_size(c).cast("long") for c in ("cited", "verified", "missing"))
    grade = F.when(F.coalesce(n, F.lit(0)) == 0, None).when((v == n) & (u == 0), 2).when(v > 0, 1).otherwise(0)
    return rows.select("id", n.alias("n_cited"), v.alias("n_verified"), u.alias("n_unsaid"), grade.alias("fidelity"), F.coalesce(n > v, F.lit(False)).alias("invention"))


_PASSED = "len(list_filter(must_cite, lambda c: not contains(lower(coalesce(answer, '')), c))) = 0 and len(list_filter(must_not, lambda c: contains(lower(coalesce(answer, '')), c))) = 0"


@query(f"with {ANSWERS.sql('answers')} select kind, grouping(kind) as total, count(*) as n, count(*) filter (where {_PASSED}) as passed from answers group by rollup (kind)")
def eval_summary(spark: SparkSession, root: str) -> DataFrame:
    """Cases that cite all they must and nothing they must not, by kind and overall."""
    text = F.lower(F.coalesce("answer", F.lit("")))
    passed = F.forall("must_cite", lambda c: F.contains(text, c)) & ~F.exists("must_not", lambda c: F.contains(text, c))
    rows = ANSWERS.frame(spark).withColumn("passed", passed)
    return rows.rollup("kind").agg(F.grouping("kind").cast("long").alias("total"), F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query(f"with {JOBS.sql('jobs')} select id, status, row_number() over (order by status <> 'running', requested_at, id) as place from jobs where status in ('queued', 'running') order by 3 limit 20")
def queue_head(spark: SparkSession, root: str) -> DataFrame:
    """The first 20 of the queue with their places: running ones, then by age."""
    rows = JOBS.frame(spark).where("status in ('queued', 'running')").orderBy(*queue.in_order()).limit(20)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*queue.in_order())).cast("long")).select("id", "status", "place")


@query(f"with {JOBS.sql('jobs')}, next as (select id from jobs where status = 'queued' order by requested_at, id limit 2) select id, case when id in (select id from next) then 'running' else status end as status from jobs")
def queue_claim(spark: SparkSession, root: str) -> DataFrame:
    """The jobs after the two oldest queued ones are claimed."""
    return queue.claim(JOBS.frame(spark), 2).select("id", "status")


@query(
    f"""with {JOBS.sql('jobs')} select id, case when status = 'running' then case when attempts = 1 then 'done' else 'failed' end else status end as status,
  attempts + case when status = 'running' and attempts <> 1 then 1 else 0 end as attempts, case when status = 'running' and attempts <> 1 then 'download failed' else reason end as reason from jobs"""
)
def queue_settle(spark: SparkSession, root: str) -> DataFrame:
    """The jobs after every running one has ended, well where it was the second attempt."""
    rows = JOBS.frame(spark)
    ends = rows.where("status = 'running'").select("id", (F.col("attempts") == 1).alias("ok"), F.lit("download failed").alias("reason"))
    return queue.settle(rows, ends).select("id", "status", "attempts", "reason")


@query(f"with {JOBS.sql('jobs')} select id, attempts from jobs where status = 'failed' and attempts between 1 and 2")
def retryable(spark: SparkSession, root: str) -> DataFrame:
    """Jobs that failed, but not three times."""
    return JOBS.frame(spark).where(f"status = 'failed' and attempts between 1 and {queue.MAX_ATTEMPTS - 1}").select("id", "attempts")


@query(f"with {JOBS.sql('jobs')} select id, case when status = 'done' then null when status in ('queued', 'running') then 'analyzing' when status = 'failed' and attempts >= 3 then 'no_source' when status = 'failed' then 'retry_pending' end as state from jobs")
def queue_annotated(spark: SparkSession, root: str) -> DataFrame:
    """What the library shows for each job."""
    return JOBS.frame(spark).select("id", queue.state_of(F.col("status") == "done", F.col("status"), F.col("attempts")).alias("state"))


@query(f"with {LISTS.sql('lists')} select list_id from lists where coalesce(collaborative, false) or coalesce(owner = 'me', false)")
def own_lists(spark: SparkSession, root: str) -> DataFrame:
    """Playlists that a listener may import: own or collaborative ones."""
    return LISTS.frame(spark).where(F.coalesce("collaborative", F.lit(False)) | F.coalesce(F.col("owner") == "me", F.lit(False))).select("list_id")


_FACT_SQL = f"""{SECTIONS.sql('tracks')}, good as (select id, sections::json as j from tracks where json_valid(sections)), arr as (select id, j, cast(json_array_length(j) as bigint) as n from good where json_type(j) = 'ARRAY'),
one as (select id, i as section_index, json_extract(j, '$[' || cast(i as varchar) || ']') as s from arr, unnest(range(n)) u(i) where n <= 60),
parts as (select id, section_index, cast(s->>'start' as double) as a, cast(s->>'end' as double) as b, cast(s->>'label' as integer) as label, cast(s->>'tempo_bpm' as double) as tempo_bpm, cast(s->>'loudness_db' as double) as loudness_db, cast(s->>'key' as integer) as key, s->>'mode' as mode from one),
fact as (select id, section_index, round(a, 2) as start_sec, round(b, 2) as end_sec, round(b - a, 2) as duration_sec, label, tempo_bpm, loudness_db, key, mode from parts where b - a >= 1)"""
_SUMMARY_SQL = f"""{_FACT_SQL}, summary as (select id, count(*) as n_sections, round(avg(duration_sec), 2) as mean_section_sec, max(duration_sec) as longest_section_sec, count(distinct key) as n_distinct_keys, count(distinct mode) as n_distinct_modes,
  round(max(loudness_db) - min(loudness_db), 2) as loudness_range_db, round(max(tempo_bpm) - min(tempo_bpm), 1) as tempo_range_bpm, count(distinct key) > 1 as changes_key, count(distinct mode) > 1 as changes_mode from fact group by 1)"""


def section_rows(tracks: DataFrame) -> DataFrame:
    """One row per (track, section) of a column of JSON lists; lists of more than 60 parts and parts under 1 s are left out."""
    s = tracks.select("id", F.explode(sections(F.col("sections"))).alias("s"))
    return s.select(
        "id", F.col("s.section_index").cast("long").alias("section_index"), F.round("s.start", 2).alias("start_sec"), F.round("s.end", 2).alias("end_sec"), F.round(F.col("s.end") - F.col("s.start"), 2).alias("duration_sec"),
        "s.label", "s.tempo_bpm", "s.loudness_db", "s.key", "s.mode",
    )


def section_summary_of(fact: DataFrame) -> DataFrame:
    """Back to one row per track: how its parts differ."""
    keys, modes = F.count_distinct("key"), F.count_distinct("mode")
    return fact.groupBy("id").agg(
        F.count("*").alias("n_sections"), F.round(F.avg("duration_sec"), 2).alias("mean_section_sec"), F.max("duration_sec").alias("longest_section_sec"), keys.alias("n_distinct_keys"), modes.alias("n_distinct_modes"),
        F.round(F.max("loudness_db") - F.min("loudness_db"), 2).alias("loudness_range_db"), F.round(F.max("tempo_bpm") - F.min("tempo_bpm"), 1).alias("tempo_range_bpm"), (keys > 1).alias("changes_key"), (modes > 1).alias("changes_mode"),
    )


@query(f"with {_FACT_SQL} select * from fact")
def section_facts(spark: SparkSession, root: str) -> DataFrame:
    return section_rows(SECTIONS.frame(spark))


@query(f"with {_SUMMARY_SQL} select * from summary")
def section_summary(spark: SparkSession, root: str) -> DataFrame:
    return section_summary_of(section_rows(SECTIONS.frame(spark)))


@query(
    f"""with {_SUMMARY_SQL} select count(*) as n_tracks, cast(sum(n_sections) as bigint) as n_sections, round(avg(n_sections), 2) as mean_sections, round(avg(cast(changes_key as integer)) * 100, 1) as pct_change_key,
  round(avg(cast(changes_mode as integer)) * 100, 1) as pct_change_mode, round(median(loudness_range_db), 1) as median_loudness_range_db, round(median(mean_section_sec), 1) as median_section_sec from summary"""
)
def structure_facts(spark: SparkSession, root: str) -> DataFrame:
    """What the parts of all tracks say about the corpus."""
    s = section_summary_of(section_rows(SECTIONS.frame(spark)))
    share = {c: F.round(F.avg(F.col(c).cast("int")) * 100, 1) for c in ("changes_key", "changes_mode")}
    return s.agg(
        F.count("*").alias("n_tracks"), F.sum("n_sections").alias("n_sections"), F.round(F.avg("n_sections"), 2).alias("mean_sections"), share["changes_key"].alias("pct_change_key"), share["changes_mode"].alias("pct_change_mode"),
        F.round(F.median("loudness_range_db"), 1).alias("median_loudness_range_db"), F.round(F.median("mean_section_sec"), 1).alias("median_section_sec"),
    )
