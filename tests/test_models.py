import numpy as np

from undertone.operators import models


def _rows(spark, n=300):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.2, (n // 2, 3)), rng.normal(3, 0.2, (n // 2, 3))])
    return spark.createDataFrame([(f"{i:04}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>"), x


def test_clusters_and_projection(spark):
    df, _ = _rows(spark)
    assigned, k, score = models.fit_clusters(df, "v", range(2, 5))
    assert k == 2 and score > 0.8 and sorted(r["count"] for r in assigned.groupBy("cluster_id").count().collect()) == [150, 150]
    assert {"map_x", "map_y"} <= set(models.project(df, "v").columns)


def test_whitening(spark):
    df, x = _rows(spark)
    w = models.whitening_matrix(df, "v", 3, shrinkage=0.0)
    u = np.array([r["u"] for r in models.apply_matrix(df, "v", w, "u").orderBy("id").collect()])
    assert np.allclose(np.cov(u.T), np.eye(3), atol=1e-6)
    assert models.whitening_matrix(df.limit(20), "v", 3) is None


def test_recall_and_split(spark):
    ranked = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "z", 1)], "seed string, item string, rank int")
    truth = spark.createDataFrame([("s", "a"), ("s", "q"), ("s", "r"), ("t", "y")], "seed string, item string")
    assert {r["seed"]: r["recall"] for r in models.recall_at(ranked, truth, 2).collect()} == {"s": 0.5, "t": 0.0}
    a, b = models.hash_split(spark.range(1000).withColumnRenamed("id", "k"), "k", 0.2)
    assert 120 < a.count() < 280 and a.count() + b.count() == 1000


def test_nearest_and_labels(spark):
    df, x = _rows(spark, 60)
    got = [r["item"] for r in models.nearest_k(df, "id", "v", df.where("id = '0000'"), 3).orderBy("rank").collect()]
    want = [f"{i:04}" for i in np.argsort(((x - x[0]) ** 2).sum(1))[1:4]]
    assert got == want
    rows = spark.createDataFrame([(0, 1.0), (0, 1.1), (1, 9.0), (1, 9.1), (2, 5.0)], "c int, tempo double")
    labels = {r["c"]: r["label"] for r in models.label_clusters(rows, "c", {"tempo": ("fast", "slow")}).collect()}
    assert labels == {0: "slow", 1: "fast", 2: "slow"}
    flat = spark.createDataFrame([(0, 3.0), (1, 3.0)], "c int, tempo double")
    assert {r["label"] for r in models.label_clusters(flat, "c", {"tempo": ("fast", "slow")}).collect()} == {"Mixed"}


def _brute(ids, x, seeds, k):
    want = {}
    for s in seeds:
        d = np.sqrt(((x - x[ids.index(s)]) ** 2).sum(1))
        order = sorted((round(float(v), 9), i) for i, v in zip(ids, d) if i != s)[:k]
        want[s] = [i for _, i in order]
    return want


def test_many_seeds_in_blocks_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (1500, 3)).astype(float)  # many ties and copies
    ids = [f"{i:04}" for i in range(1500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [("null", None), (None, [0.0, 0.0, 0.0])], "id string, v array<double>").repartition(7)
    seeds = ids[::50]
    got = {}
    for r in models.nearest_k(df, "id", "v", df.where(df.id.isin(seeds)), 5, block=8).orderBy("seed", "rank").collect():
        got.setdefault(r["seed"], []).append(r["item"])
    assert got == _brute(ids, x, seeds, 5)
    few = models.nearest_k(df.limit(3), "id", "v", df.limit(3), 5)
    assert few.count() == 6
    assert models.nearest_k(df, "id", "v", df.where("false"), 5).count() == 0


def test_whitened_search_takes_every_stated_seed(spark):
    from pathlib import Path

    import pytest

    from undertone import catalogue
    from undertone.plans.base import is_seed
    from undertone.plans.learned import _complete

    root = "/root/testdata/sf0.01"
    if not Path(root).exists():
        pytest.skip("no test data")
    want = {r["id"] for r in _complete(spark, root).where(is_seed("id")).collect()}
    got = catalogue.queries()["whitened_neighbours"](spark, root).collect()
    assert len(want) > 5 and {r["seed"] for r in got} == want and len(got) == 10 * len(want)


def test_similar_search_against_brute_force(spark):
    from pathlib import Path

    import pytest

    from undertone import catalogue
    from undertone.plans.base import is_seed
    from undertone.plans.joins import similarity_plane

    root = "/root/testdata/sf0.01"
    if not Path(root).exists():
        pytest.skip("no test data")
    rows = similarity_plane(spark, root).withColumn("seed", is_seed("id")).collect()
    ids, x, seeds = [r["id"] for r in rows], np.array([r["v"] for r in rows]), [r["id"] for r in rows if r["seed"]]
    got = {}
    for r in catalogue.queries()["similar_search"](spark, root).orderBy("seed", "rank").collect():
        got.setdefault(r["seed"], []).append(r["item"])
    assert len(seeds) > 5 and got == _brute(ids, x, seeds, 6)
