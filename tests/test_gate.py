"""The match gate, the queue and the section grain by hand-computed values."""

import datetime

import pytest
from pyspark.sql import functions as F

from undertone.functions import matching as m
from undertone.operators import jobs
from undertone.plans.fixtures import section_rows, section_summary_of
from undertone.plans.pages import page_bounds, page_of


def _value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, candidate, contained, recall",
    [
        ("Hop & Drop", "Salty Hop My Day", False, 0.5), ("Amber Kite - Radio Edit", "Zed - Amber Kite (Official Audio)", True, 1.0), ("Skyfaxes", "SKY FAXES", True, 1.0), ("A", "A", False, 0.0),
        ("Rumours of the Old Sea", "Rumors of the Old Sea", False, 2 / 3), ("Peace (feat. Ono)", "peace", True, 1.0), (None, "x", False, 0.0), ("Kite", None, False, 0.0),
    ],
)
def test_titles(spark, title, candidate, contained, recall):
    a, b = F.lit(title).cast("string"), F.lit(candidate).cast("string")
    assert _value(spark, m.contains_title(a, b)) is contained and _value(spark, m.recall(a, b)) == pytest.approx(recall)


def test_artists_and_reproductions(spark):
    s = lambda x: F.lit(x).cast("string")
    assert _value(spark, m.performed_by(s("QRT"), s("Dorian - Not Home (QRT Remix)"), s(None))) is False
    assert _value(spark, m.performed_by(s("QRT"), s("Home"), s("QRT - Topic"))) is True
    assert _value(spark, m.performed_by(s("the official"), s("the official"), s(None))) is False
    assert _value(spark, m.reproduction(s("Drift Off (Ableton Remake)"), s(None))) is True and _value(spark, m.reproduction(s("Drift Off Remix"), s(None))) is False


def test_lengths_and_scores(spark):
    d = lambda x: F.lit(x).cast("double")
    cases = [(200, 210, False, False), (200, 240, True, False), (None, 240, True, False), (1900, None, True, True), (700, 200, True, True), (0, 200, True, False)]
    assert [(_value(spark, m.other_length(d(a), d(b))), _value(spark, m.too_long(d(a), d(b)))) for a, b, _, _ in cases] == [c[2:] for c in cases]
    for title, sec, want in (("Amber (Official Audio)", 201, 35), ("Amber Live Cover", 246, -60), ("Amber", None, 0), ("Amber lyrics", 224, 10), (None, 244, -10)):
        assert _value(spark, m.score(F.lit(title).cast("string"), d(sec), d(200))) == want


def _jobs(spark, rows):
    t = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, s, t + datetime.timedelta(hours=h), a, None) for i, s, h, a in rows], jobs.SCHEMA)


def test_queue_transitions(spark):
    q = _jobs(spark, [("a", "queued", 2, 0), ("b", "queued", 1, 0), ("c", "failed", 0, 2), ("d", "failed", 0, 3), ("e", "running", 0, 1), ("f", "done", 0, 0)])
    state = lambda df: {r["id"]: (r["status"], r["attempts"]) for r in df.collect()}
    ids = spark.createDataFrame([("c",), ("d",), ("g",), ("g",), (None,), ("f",)], "id string")
    asked = state(jobs.enqueue(q, ids, F.lit("2026-01-02 00:00:00")))
    assert asked == {"a": ("queued", 0), "b": ("queued", 0), "c": ("queued", 2), "d": ("failed", 3), "e": ("running", 1), "f": ("done", 0), "g": ("queued", 0)}
    assert state(jobs.claim(q))["b"] == ("running", 0) and state(jobs.claim(q))["a"] == ("queued", 0)
    ends = spark.createDataFrame([("e", False, "no source"), ("a", True, None)], "id string, ok boolean, reason string")
    assert state(jobs.settle(q, ends))["e"] == ("failed", 2) and state(jobs.settle(q, ends))["a"] == ("queued", 0)
    assert state(jobs.requeue_stale(q, F.lit("2026-01-01 01:00:00").cast("timestamp_ntz")))["e"] == ("queued", 1)
    planes, dead = jobs.quarantine({"f": (spark.createDataFrame([("a", 1), ("b", 2)], "track string, x int"), "track")}, q, spark.createDataFrame([("a", "wrong"), (None, "x")], "id string, reason string"))
    assert [r["track"] for r in planes["f"].collect()] == ["b"] and state(dead)["a"] == ("failed", 3) and state(dead)["b"] == ("queued", 0)


def test_sections(spark):
    text = '[{"start":0,"end":10,"key":1,"mode":"major","loudness_db":-8,"tempo_bpm":100},{"start":10,"end":10.5,"key":9},{"start":10.5,"end":31,"key":2,"mode":"major","loudness_db":-11.5,"tempo_bpm":103.26}]'
    rows = section_rows(spark.createDataFrame([("t", text), ("u", "oops"), ("v", None)], "id string, sections string"))
    assert [(r["section_index"], r["duration_sec"]) for r in rows.orderBy("section_index").collect()] == [(0, 10.0), (2, 20.5)]
    r = section_summary_of(rows).first()
    assert (r["n_sections"], r["mean_section_sec"], r["n_distinct_keys"], r["changes_key"], r["changes_mode"], r["loudness_range_db"], r["tempo_range_bpm"]) == (2, 15.25, 2, True, False, 3.5, 3.3)


def test_pages(spark):
    assert page_bounds(1001, 99, 50) == (1000, 50) and page_bounds(10, "x", 7) == (0, 100) and page_bounds(10, 3, "all") == (0, 10) and page_bounds(0, -2, "250") == (0, 250)
    df = spark.createDataFrame([(str(i), f"n{i}", None if i == 3 else i) for i in range(7)], "id string, name string, tempo int")
    assert [r["id"] for r in page_of(df, "tempo", 1, 50).collect()] == ["6", "5", "4", "2", "1", "0", "3"]
    assert [r["id"] for r in page_of(df, "nothing", 1, "all").collect()] == list("0123456")
