from undertone.streaming.events import drain, land_latest, windowed_counts


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01 01:00:00", "a", 1.0), ("2026-01-01 23:00:00", "a", 2.0), ("2026-01-02 00:00:00", "b", 4.0)], "ts string, event_type string, value double")
    path = f"file://{tmp_path}/in"
    df.selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(path)
    got = {(str(r["w"]["start"])[:10], r["event_type"]): (r["n"], r["total"]) for r in drain(windowed_counts(stream), "t").collect()}
    assert got == {("2026-01-01", "a"): (2, 3.0), ("2026-01-02", "b"): (1, 4.0)}


def test_land_latest(spark, tmp_path):
    source, target, progress = (f"file://{tmp_path}/{n}" for n in ("src", "out", "cp"))
    for n, rows in enumerate([[("k", 1, "old"), ("j", 1, "j")], [("k", 2, "new")]]):
        spark.createDataFrame(rows, "k string, t int, v string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, t int, v string").parquet(source)
        land_latest(stream, target, progress, "k", "t").awaitTermination()
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{target}/v{n % 2}").collect()} == {("k", "new"), ("j", "j")}
