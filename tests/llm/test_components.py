import random

from undertone.llm.components import hash_to_min


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def _run(spark, edges):
    df = spark.createDataFrame([(a, b, "v", 1) for a, b in edges], "a string, b string, vertex string, n int")
    return {r["vertex"]: r["component"] for r in hash_to_min(df, "a", "b").collect()}


def test_random_graphs_and_chains(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(110)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"s{i}") for i in range(60)]
    edges += [(None, "x"), ("y", None), edges[0], ("aé", "aÉ")]
    assert _run(spark, edges) == _brute(edges)


def test_empty(spark):
    assert _run(spark, []) == {}


def test_hot_vertex_takes_the_bounded_broadcast(spark, monkeypatch):
    import undertone.llm.components as c
    import undertone.skew as skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    monkeypatch.setattr(c, "HOT_ROWS", 20)
    edges = [("hub", f"s{i:03}") for i in range(90)] + [("s001", "t")]
    assert _run(spark, edges) == _brute(edges)
