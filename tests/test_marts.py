"""Written marts and the evaluation operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.operators import evaluation as ev
from undertone.sources import marts


def test_versions_are_replaced_and_restored(spark, tmp_path):
    folder = f"file://{tmp_path}/mart"
    for i in range(3):
        marts.replace(spark.createDataFrame([(i,)], "x int"), folder)
    assert marts.current(spark, folder).first()["x"] == 2 and marts.versions(spark, folder) == ["v00000002", "v00000003"]
    marts.restore(spark, folder, "v00000002")
    assert marts.current(spark, folder).first()["x"] == 1
    with pytest.raises(Exception, match="v00000009"):
        marts.restore(spark, folder, "v00000009")
    with pytest.raises(FileNotFoundError):
        marts.current(spark, f"file://{tmp_path}/none")


def test_contracts_and_clashes(spark):
    df = spark.createDataFrame([("a", 1, "l")], "id string, n int, x string")
    assert marts.present_columns(df, ["x", "q", "id"]).columns == ["x", "id"]
    assert marts.require_columns(df, {"n": "int"}) is df
    with pytest.raises(ValueError, match="q: missing; n: int for bigint"):
        marts.require_columns(df, {"q": "int", "n": "bigint"})
    both = marts.join_suffixed(df, spark.createDataFrame([("a", "r", 2.0)], "id string, x string, y double"), "id")
    assert both.columns == ["id", "n", "x", "x_f", "y"] and tuple(both.first()) == ("a", 1, "l", "r", 2.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    paths = marts.save_top_items({"tracks": df, "artists": df.limit(0)}, f"file://{tmp_path}/top")
    assert list(paths) == ["tracks"] and spark.read.parquet(paths["tracks"]).count() == 2
    body = marts.insights({"counts": df}, f"file://{tmp_path}/report")
    assert body == {"schema_version": 1, "counts": [{"k": "a", "n": 1}, {"k": "b", "n": 2}]} and "| a | 1 |" in (tmp_path / "report.md").read_text()


def test_bootstrap_and_null_model(spark):
    x = np.random.default_rng(3).normal(5, 2, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    low, high = ev.bootstrap_interval(df, "i", "v", 300)
    assert ev.bootstrap_interval(df.repartition(7), "i", "v", 300) == pytest.approx((low, high))
    half = 1.96 * x.std() / 20
    assert abs(low - (x.mean() - half)) < 0.1 and abs(high - (x.mean() + half)) < 0.1
    assert ev.bootstrap_interval(df.limit(0), "i", "v") is None
    df = spark.createDataFrame([(str(i), i, i) for i in range(200)], "id string, a int, b int")
    rows = ev.shuffled_columns(df, "id", ["a", "b"], 1).collect()
    assert sorted(r["a"] for r in rows) == list(range(200)) == sorted(r["b"] for r in rows) and abs(np.corrcoef([r["a"] for r in rows], [r["b"] for r in rows])[0, 1]) < 0.3
    assert ev.p_value(2.0, [1.0, 3.0, 0.5]) == 0.5


def test_negatives_are_no_partners(spark):
    items = spark.range(100).select(F.col("id").alias("item"))
    truth = spark.createDataFrame([(s, i) for s in range(5) for i in range(50)], "seed long, item long")
    rows = ev.negatives(items.where("item < 5").withColumnRenamed("item", "seed"), items, truth, 10).collect()
    assert rows and all(r["item"] >= 50 for r in rows) and len({r["seed"] for r in rows}) == 5


def test_identities():
    old = {0: ("Loud", [1.0, 0.0]), 1: ("Slow", [0.0, 1.0])}
    assert ev.match_identity(old, {5: ("Slow", [0.1, 0.9]), 6: ("Loud", [2.0, 0.1])}) == {5: 1, 6: 0}
    assert ev.match_identity(old, {5: ("Slow", [0.1, 0.9]), 6: ("Quiet", [2.0, 0.1])}) is None and ev.match_identity(old, {5: ("Slow", [0.0, 1.0])}) is None


def test_first_mentions(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 3)], "g string, item string, o int")
    assert ev.first_mentions(df, "g", "item", "o").first()["items"] == ["b", "a"]
