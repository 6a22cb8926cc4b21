import numpy as np

from undertone.llm.neighbours import nearest_vectors


def _rows(seed=1, n=3000, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 3
    return centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * 0.5


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "id string, v array<double>, n int, distance double")
    out = {}
    for r in nearest_vectors(df, "id", "v", 5, **kw).collect():
        out.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    return out


def test_recall_over_shards(spark):
    x = _rows().astype(np.float32)
    got = _run(spark, [(f"{i:05}", [float(y) for y in v]) for i, v in enumerate(x)], shard_size=500)
    hits = 0
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len({f"{j:05}" for j in np.argsort(d)[:5]} & {n for _, n in got[f"{i:05}"]})
        assert len(got[f"{i:05}"]) == 5
    assert hits / (5 * len(x)) >= 0.95


def test_copies_ties_and_dirt(spark):
    rows = [(f"c{i:02}", [1.0, 1.0]) for i in range(40)] + [("far", [9.0, 9.0]), ("near", [1.5, 1.0]), ("nul", None), ("bad", [1.0, float("nan")]), (None, [1.0, 1.0]), ("far", [9.0, 9.0])]
    got = _run(spark, rows)
    assert {n for _, n in got["c05"]} == {"c00", "c01", "c02", "c03", "c04"}
    assert {n for _, n in got["c00"]} == {"c01", "c02", "c03", "c04", "c05"}
    assert {n for _, n in got["near"]} == {"c00", "c01", "c02", "c03", "c04"}
    assert [n for _, n in sorted(got["far"])][0] == "near" and len(got["far"]) == 5
    assert "nul" not in got and "bad" not in got


def test_small_and_empty(spark):
    assert _run(spark, []) == {}
    assert _run(spark, [("a", [1.0])]) == {}
    assert _run(spark, [("a", [1.0]), ("b", [3.0])]) == {"a": [(2.0, "b")], "b": [(2.0, "a")]}
