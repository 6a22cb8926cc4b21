"""Registered queries against their SQL, on the smallest data set where it is there."""

import os
from pathlib import Path

import pytest

from undertone import catalogue

ROOT = Path(os.environ.get("UNDERTONE_TESTDATA", "/root/testdata/sf0.001"))
SOME = ["taste_drift", "perceptual_axes", "artist_index", "twin_collapse", "asof_join", "sessions", "feature_histograms", "model_freshness", "release_age", "artist_last_known"]

pytestmark = pytest.mark.skipif(not ROOT.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in ROOT.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(row):
    return tuple(None if v != v else round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(ROOT))
    res = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((_plain([r[c] for c in cols]) for r in df.collect()), key=repr) == sorted(map(_plain, res.fetchall()), key=repr)


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = _plan(catalogue.queries()["pricing_summary"](spark, str(ROOT)))
    assert "l_comment" not in plan and "l_partkey" not in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan


def test_duplicate_pairs_are_no_cross_join(spark):
    plan = _plan(catalogue.queries()["duration_duplicates"](spark, str(ROOT)))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_version_totals_leave_no_track_out(spark, duck):
    rows = catalogue.queries()["version_totals"](spark, str(ROOT))
    res = duck.execute(catalogue.oracle_sql()["version_totals"])
    cols = [d[0] for d in res.description]
    assert sorted((_plain([r[c] for c in cols]) for r in rows.collect()), key=repr) == sorted(map(_plain, res.fetchall()), key=repr)
    tracks = duck.execute(f"select count(distinct spotify_track_id) from '{ROOT}/track_perceptual.parquet'").fetchone()[0]
    assert sum(r["n"] for r in rows.collect()) == tracks
