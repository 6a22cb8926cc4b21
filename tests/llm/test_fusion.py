from pyspark.sql import functions as F

from undertone.llm.fusion import discover_truth

SCHEMA = "g string, r string, s string, name string, n long, `g_extra` string"


def _run(spark, rows, trust=None):
    df = spark.createDataFrame(rows, SCHEMA)
    truths, weights = discover_truth(df, "g", "r", "s", ["name", "n"], trust)
    return {(t["g"], t["field_name"]): (t["value"], t["r"]) for t in truths.collect()}, {(w["s"], w["field_name"]): w["reliability"] for w in weights.collect()}


def test_reliable_sources_win_votes(spark):
    rows = []
    for i in range(20):
        rows += [(f"g{i}", f"a{i}", "good", "x", 1, None), (f"g{i}", f"b{i}", "fair", "x", 1, None), (f"g{i}", f"c{i}", "bad", "y", 2, None)]
    rows += [("tie", "p", "bad", "wrong", None, None), ("tie", "q", "good", "right", None, None)]
    truths, weights = _run(spark, rows)
    assert truths["tie", "name"] == ("right", "q")
    assert weights["good", "name"] > weights["bad", "name"]


def test_trust_outranks_votes_and_blanks_are_no_value(spark):
    rows = [("g", "a", "s1", " ", 5, None), ("g", "b", "s2", "v", 5, None), ("g", "c", "s2", "w", None, None), ("g", "d", "s2", "w", None, None), (None, "e", "s", "z", 1, None), ("g", None, "s", "z", 1, None)]
    truths, _ = _run(spark, rows, [F.col("r")])
    assert truths == {("g", "name"): ("v", "b"), ("g", "n"): ("5", "a")}


def test_repeats_and_empty(spark):
    rows = [("g", "a", None, "v", 1, None)] * 3 + [("g", "b", None, "w", 1, None), ("g", "c", None, "w", 1, None)]
    truths, _ = _run(spark, rows)
    assert truths["g", "name"] == ("w", "b")
    assert _run(spark, [])[0] == {}


def test_rounds_change_what_the_first_vote_chose(spark):
    from undertone.llm import fusion

    rows = []
    for i in range(30):
        rows += [(f"g{i}", f"a{i}", "good", "x", 1, None), (f"g{i}", f"b{i}", "fair", "x", 1, None), (f"g{i}", f"c{i}", "bad", "y", 2, None), (f"g{i}", f"d{i}", "poor", "z", 3, None)]
    # One vote of a good source against one of a bad source whose record id is smaller: equal weights choose the latter.
    rows += [("split", "p", "bad", "wrong", None, None), ("split", "q", "good", "right", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)

    def chosen(**kw):
        return {(t["g"], t["field_name"]): t["value"] for t in fusion.discover_truth(df, "g", "r", "s", ["name", "n"], **kw)[0].collect()}

    assert chosen(tolerance=1.0)["split", "name"] == "wrong" and chosen()["split", "name"] == "right"


def _brute(rows, fields, rounds=60):
    claims = {}
    for g, r, s, *values in rows:
        for f, v in zip(fields, values):
            if v is not None and str(v).strip():
                claims.setdefault((g, f, str(v)), {}).setdefault(s, set()).add(r)
    w = {}
    for _ in range(rounds):
        best = {}
        for (g, f, v), by in claims.items():
            key = (-sum(w.get((s, f), 0.8) * len(ids) for s, ids in by.items()), min(min(ids) for ids in by.values()), v)
            best[g, f] = min(best.get((g, f), key), key)
        hit, all_ = {}, {}
        for (g, f, v), by in claims.items():
            for s, ids in by.items():
                all_[s, f] = all_.get((s, f), 0) + len(ids)
                hit[s, f] = hit.get((s, f), 0) + len(ids) * (best[g, f][2] == v)
        fresh = {k: (hit[k] + 4.0) / (all_[k] + 5.0) for k in all_}
        done = max(abs(fresh[k] - w.get(k, 0.8)) for k in fresh) <= 1e-3
        w = fresh
        if done:
            break
    return {k: (v[2], v[1]) for k, v in best.items()}


def test_votes_match_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(f"g{g}", f"r{g}-{i}", rng.choice("abcde"), rng.choice(["x", "y", "z", None, ""]), rng.choice([1, 2, None]), None) for g in range(60) for i in range(rng.randrange(1, 7))]
    got, _ = _run(spark, rows)
    assert got == _brute([r[:5] for r in rows], ["name", "n"])


def test_p1_found_runs_no_rounds_without_effect(spark, tmp_path, monkeypatch):
    from undertone.llm import queries

    def rounds(*_, **__):
        raise AssertionError("votes cannot change what a total order settles")

    monkeypatch.setattr(queries, "discover_truth", rounds)
    spark.createDataFrame([(1, ["a", "b", "c", None, "a"]), (2, ["d"]), (None, ["a"])], "cluster_key long, members array<string>").write.parquet(f"{tmp_path}/duplicate_clusters.parquet")
    spark.createDataFrame([("a", None), ("b", True), ("b", None), ("c", False)], "track_id string, is_cached boolean").write.parquet(f"{tmp_path}/dedup_records.parquet")
    meta = [("a", "I1", "2001", 5, "u", 300), ("b", " ", None, None, "", 100), ("c", "I3", "", 7, None, 400)]
    spark.createDataFrame(meta, "spotify_track_id string, isrc string, album_release_date string, popularity int, album_image_url string, duration_ms long").write.parquet(f"{tmp_path}/track_meta.parquet")
    spark.createDataFrame([], "spotify_track_id string, extraction_source string, extracted_at timestamp").write.parquet(f"{tmp_path}/track_features.parquet")
    got = {tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect()}
    want = {(1, "record", "b"), (1, "isrc", "c"), (1, "album_release_date", "a"), (1, "popularity", "c"), (1, "album_image_url", "a"), (1, "duration_ms", "b"), (2, "record", "d")}
    assert got == want
