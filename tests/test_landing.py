from pyspark.sql import functions as F

from undertone.sources import landing


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/landed"
    a = spark.createDataFrame([("t1", 1.0), ("t2", 2.0)], "id string, x double")
    b = spark.createDataFrame([("t1", 3.0, "new")], "id string, x double, y string")
    assert landing.land(a, folder, "local", "2026-01-01T00:00:00", "first")
    assert landing.land(b, folder, "local", "2026-02-01T00:00:00", "second")
    assert not landing.land(a.limit(0), folder, "local", "2026-03-01T00:00:00", "none")
    rows = landing.scan(spark, folder)
    got = {r["id"]: (r["x"], r["y"]) for r in landing.cleansed(rows, ["id"]).collect()}
    assert got == {"t1": (3.0, "new"), "t2": (2.0, None)}
    m = landing.manifest(spark, folder)
    assert m.agg(F.sum("rows")).first()[0] == 3 and {r["snapshot_label"] for r in m.collect()} == {"first", "second"}
    assert landing.scan(spark, f"{folder}-missing", a.schema).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, "x")], "k string, v int, w string")
    assert {(r["k"], r["v"]) for r in landing.upsert(old, new, "k").collect()} == {("a", 1), ("b", 3)}
    log = spark.createDataFrame([("k", 1, "n", 5), ("k", 2, " ", None), ("k", 3, None, 7)], "k string, t int, name string, n int")
    r = landing.last_known(log, "k", ["t"], ["name"], ["n"]).first()
    assert (r["name"], r["n"]) == ("n", 7)
