import numpy as np

from undertone.llm.clusters import group_similar


def _run(spark, rows, k, **kw):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "id string, v array<double>, cell int, `group` int")
    members, medoids = group_similar(df, "id", "v", k, **kw)
    return {r["id"]: r["group"] for r in members.collect()}, {r["group"]: r["size"] for r in medoids.collect()}


def _blobs(sizes, d=13, seed=5):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    centres = rng.normal(size=(len(sizes), d))
    for g, n in enumerate(sizes):
        for i in range(n):
            rows.append((f"{g}-{i}", (centres[g] * 1.0 + rng.normal(size=d) * 0.2).tolist()))
            truth[f"{g}-{i}"] = g
    x = np.array([v for _, v in rows])
    x = (x - x.mean(0)) / x.std(0)
    return [(i, v.tolist()) for (i, _), v in zip(rows, x)], truth


def test_blobs_come_out_whole(spark):
    rows, truth = _blobs([900, 300, 150, 60])
    got, sizes = _run(spark, rows + rows[:50] + [(None, rows[0][1]), ("nul", None)], 4)
    assert set(got) == set(truth)
    assert len({(truth[i], g) for i, g in got.items()}) == 4
    assert sorted(sizes.values()) == [60, 150, 300, 900]


def test_loose_component_is_split(spark):
    a, b = np.zeros(13), np.full(13, 2.0)
    rows = [(f"a{i}", (a + 0.01 * i).tolist()) for i in range(30)] + [(f"b{i}", (b + 0.01 * i).tolist()) for i in range(30)]
    steps, at = [], a + 0.15
    for k in range(13):
        for part in (0.5, 1.0):
            at = at.copy()
            at[k] = 0.15 + 2.0 * part
            steps.append((f"s{k}-{part}", at.tolist()))
    got, _ = _run(spark, rows + steps, 2)
    assert len({got[f"a{i}"] for i in range(30)}) == 1 and len({got[f"b{i}"] for i in range(30)}) == 1
    assert got["a0"] != got["b0"]


def test_edge_cases(spark):
    assert _run(spark, [], 3) == ({}, {})
    assert _run(spark, [("x", [0.0, 1.0])], 0) == ({}, {})
    got, sizes = _run(spark, [("x", [0.0, 1.0]), ("y", [0.0, 1.0])], 3)
    assert got["x"] == got["y"] and list(sizes.values()) == [2]


def test_small_group_behind_many_fragments(spark):
    rows = [(f"z{i}", [0.0] * 13) for i in range(9)]
    for a in range(13):
        for b in range(a):
            for sign in (1.0, -1.0):
                rows += [(f"f{a}-{b}-{sign}-{i}", [sign if j in (a, b) else 0.0 for j in range(13)]) for i in range(3)]
    rows += [(f"s{i}", [5.0] * 13) for i in range(2)]
    got, sizes = _run(spark, rows, 2)
    assert sorted(sizes.values()) == [2, len(rows) - 2] and got["s0"] == got["s1"] != got["z0"]


def test_loose_part_is_seated_to_its_end(spark):
    from undertone.durable import Scratch
    from undertone.llm.clusters import _split_loose

    cells = [(i, 1, [10.0 * i], 100.0 * i * i, [10.0 * i], 7, 50 - i) for i in range(5)]
    state = spark.createDataFrame(cells, "cell long, n long, sum array<double>, norm double, mean array<double>, part long, degree long")
    got = {r["cell"]: r["part"] for r in _split_loose(Scratch(spark, "t"), state, 1, 2.0, 2).collect()}
    assert got == {i: i for i in range(5)}
