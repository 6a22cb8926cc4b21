import math

import pytest
from pyspark.sql import functions as F

from undertone.functions.numbers import clean, number, zscale
from undertone.functions.text import squeeze
from undertone.functions.vectors import cosine, euclid
from undertone.operators.aggregates import banded, centroids, histogram_bin, sigma_shift, unpivot
from undertone.operators.entities import artists_agree, canonical_member, components, durations_agree, title_key
from undertone.operators.ranking import average_rank_shares, keep_latest, top_per_group
from undertone.skew import split_join
from undertone.sources.cleansing import fill


def _col(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr).first()[0]


def test_average_rank_shares(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 1.0, 1.0), ("c", 3.0, None), ("d", 2.0, None), ("e", None, None)], "id string, v double, w double")
    got = {r["id"]: (r["v"], r["w"]) for r in average_rank_shares(df, "id", ["v", "w"]).collect()}
    assert got == {"a": (0.875, 0.75), "b": (0.25, 0.75), "c": (0.875, None), "d": (0.5, None), "e": (None, None)}


def test_rank_shares_over_many_partitions(spark):
    df = spark.range(2000).select("id", (F.col("id") % 700).cast("double").alias("v")).repartition(9)
    got = {r["id"]: r["v"] for r in average_rank_shares(df, "id", ["v"]).collect()}
    order = [got[i] for i in range(700)]
    assert order == sorted(order) and math.isclose(got[0], (3 + 1) / 2 / 2000) and math.isclose(got[699], 1 - 0.5 / 2000)


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0)], "g string, x double")
    r = centroids(df, ["g"], ["x"], spread=True).first()
    assert (r["x"], r["track_count"]) == (2.0, 3) and math.isclose(r["x_std_within"], math.sqrt(2))
    assert _col(spark, clean(F.lit(float("nan")))) is None


@pytest.mark.parametrize("text, want", [("1.5", 1.5), (" 2 ", 2.0), ("1e400", None), ("abc", None), ("12d", None), ("NaN", None), (None, None), ("-.5e1", -5.0)])
def test_number(spark, text, want):
    assert _col(spark, number(F.lit(text).cast("string"))) == want


def test_constant_corpus_does_not_drift(spark):
    df = spark.createDataFrame([(g, 1.0, float(i)) for g in ("s", "l") for i in range(4)], "g string, x double, y double")
    assert {r["shift"] for r in sigma_shift(df, "g", ["x", "y"]).collect()} == {0.0}
    moved = spark.createDataFrame([("s", 0.0), ("s", 0.0), ("l", 2.0), ("l", 2.0)], "g string, x double")
    assert math.isclose(sigma_shift(moved, "g", ["x"]).first()["shift"], 2 / math.sqrt(4 / 3), rel_tol=1e-6)


def test_histogram_edges(spark):
    got = [_col(spark, histogram_bin(F.lit(v), F.lit(0.0), F.lit(1.0), F.lit(20))) for v in (0.0, 0.05, 0.999, 1.0)]
    assert got == [0, 1, 19, 19]
    assert _col(spark, banded(F.lit(0.2), [(0.15, "a"), (0.35, "b")], "c")) == "b"
    assert _col(spark, zscale(F.lit(5.0), F.lit(1.0), F.lit(0.0))) == 0.0


def test_keep_latest_and_top(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("j", None, "d")], "k string, t int, v string")
    assert {r["v"] for r in keep_latest(df, ["k"], [F.desc_nulls_last("t"), F.col("v")]).collect()} == {"b", "d"}
    assert top_per_group(df, ["k"], [F.desc_nulls_last("t"), F.col("v")], 2).count() == 3


def test_fill(spark):
    df = spark.createDataFrame([("x", float("nan"), "7", None)], "s string, d double, n string, b boolean").select("*", F.lit(None).cast("string").alias("z"))
    r = fill(df, {"s": "string", "d": "float", "n": "bigint", "b": "boolean", "z": "string", "new": "bigint"}).first()
    assert (r["s"], r["d"], r["n"], r["b"], r["z"], r["new"]) == ("x", 0.0, 7, False, "unknown", 0)
    assert dict(fill(df, {"d": "float"}).dtypes)["d"] == "float"


def test_unpivot_keeps_rows(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "k int, a double, b double")
    assert {(r["feature"], r["value"]) for r in unpivot(df, ["k"], ["a", "b"]).collect()} == {("a", 2.0), ("b", None)}


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(0.0))
    assert _col(spark, cosine(a, b)) == pytest.approx(0.6) and _col(spark, euclid(a, b)) == 4.0
    assert _col(spark, cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_squeeze(spark):
    assert _col(spark, squeeze(F.lit("  Ünï—Code é́! 7"))) == "uni code e 7"


@pytest.mark.parametrize(
    "title, want", [("Amber (feat. X) [Live] - Remastered 2011", ("amber", "live")), ("Amber - Kite Remix", ("amber", "kite remix")), ("Amber (Second Part)", ("amber second part", "")), (None, ("", "")), ("Don't", ("dont", ""))]
)
def test_title_key(title, want):
    assert title_key(title) == want


def test_pair_rules(spark):
    one = [F.lit(x) for x in (None, "i", "Zed & Ono", "ZED feat. Q")]
    assert _col(spark, artists_agree(one[0].cast("string"), one[1], one[2], one[3])) is True
    assert _col(spark, durations_agree(F.lit(None).cast("long"), F.lit(5), F.lit(True))) is True
    assert _col(spark, durations_agree(F.lit(None).cast("long"), F.lit(5), F.lit(False))) is False


def test_components_do_not_depend_on_partitions(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = [{(r["vertex"], r["component"]) for r in components(df.repartition(k), "a", "b").collect()} for k in (1, 5)]
    assert got[0] == got[1] and ("c060", "c000") in got[0] and ("y", "x") in got[0] and len(got[0]) == 64


def test_canonical_member(spark):
    rows = [("g", "b", False, 900), ("g", "a", True, 0), ("g", "c", True, 100), ("h", "z", None, None), ("h", "y", None, None)]
    df = spark.createDataFrame(rows, "g string, id string, cached boolean, ms long")
    assert {(r["g"], r["canonical_id"]) for r in canonical_member(df, "g", "id", "cached", "ms").collect()} == {("g", "c"), ("h", "y")}


def test_split_join_keeps_every_row(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("h", "H"), ("c", "C")], "k string, w string")
    assert split_join(left, right, "k", ["h"]).count() == split_join(left, right, "k", []).count() == 51
    assert split_join(left, right, "k", ["h"], "left").count() == 52
