import json
import math

import numpy as np
from pyspark.sql import functions as F

from undertone.functions import curves
from undertone.sources.records import PagedPlaylist, flatten_tracks


def test_flatten_tracks(spark):
    full = {"id": "t", "name": "N", "artists": [{"id": "1", "name": "A"}, {"id": "2", "name": "B"}], "album": {"name": "L", "images": [{"url": "u"}]}, "popularity": 3}
    rows = flatten_tracks(spark.createDataFrame([(json.dumps(full),), ('{"id": "x"}',), ("{broken",), (None,)], "j string"), "j").collect()
    got = {r["spotify_track_id"]: r for r in rows}
    assert set(got) == {"t", "x"} and got["t"]["artist_names"] == "A, B" and got["t"]["album_image_url"] == "u" and got["t"]["primary_artist_id"] == "1"
    assert got["x"]["artist_names"] is None and got["x"]["explicit"] is False


def test_paged_source(spark, tmp_path):
    for p in range(3):
        items = [{"track": {"id": f"t{p}{i}", "is_local": i == 1}} for i in range(4)] + [None]
        (tmp_path / f"page{p}.json").write_text(json.dumps({"items": items}))
    spark.dataSource.register(PagedPlaylist)
    rows = spark.read.format("playlist_pages").option("start", "6").load(str(tmp_path)).collect()
    assert sorted((r["position"], r["spotify_track_id"]) for r in rows) == [(7, "t12"), (8, "t13"), (10, "t20"), (12, "t22"), (13, "t23")]


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v array<double>").select(expr(F.col("v"))).first()[0]


def test_resample_matches_interpolation(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=37)]
    got = _one(spark, [*v, float("nan"), None], lambda c: curves.resample_unit(c))
    want = np.interp(np.linspace(0, 36, 96), np.arange(37), (np.array(v) - min(v)) / (max(v) - min(v)))
    assert np.allclose(got, want)
    assert _one(spark, [1.0] * 20, lambda c: curves.resample_unit(c)) is None and _one(spark, [1.0, 2.0], lambda c: curves.resample_unit(c)) is None


def test_fades_and_sections(spark):
    r = _one(spark, [-40.0, -30.0, -10.0, -9.0, -9.0, -10.0, -9.0, -40.0, -40.0, -40.0], curves.fade_bounds)
    assert (r["intro"], r["outro"]) == (2 / 9, 6 / 9)
    r = _one(spark, [-16.0, -15.0, -9.0, -9.0, -9.0, -9.0, -40.0], curves.fade_bounds)
    assert r["intro"] is None and r["outro"] == 5 / 6
    assert _one(spark, [-40.0, -9.0, -9.0, -9.0], curves.fade_bounds) is None
    text = json.dumps([{"start": 0, "end": 9.5, "label": 0}, {"start": 9.5, "end": 10.0, "label": 1}, {"start": 10, "end": 20, "label": 0}])
    df = spark.createDataFrame([(text,), ("nope",), (json.dumps([{"start": 0, "end": 2}] * 61),), (None,)], "s string").select(curves.sections(F.col("s")).alias("x"))
    assert [[s["section_index"] for s in r["x"] or []] for r in df.collect()] == [[0, 2], [], [], []]


def test_key(spark):
    for k in (0, 5, 11):
        for profile, mode in ((curves.MAJOR, "major"), (curves.MINOR, "minor")):
            v = [profile[(i - k) % 12] * 0.1 for i in range(12)]
            r = _one(spark, v, curves.estimate_key)
            assert (r["key"], r["mode"]) == (k, mode)
    assert _one(spark, [1.0], curves.estimate_key) is None and math.isclose(sum(curves.MAJOR), 41.79, abs_tol=0.01)
