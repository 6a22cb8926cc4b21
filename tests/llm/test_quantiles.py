import math

import numpy as np
import pytest

from undertone.llm.quantiles import DEPTH, compress, decode, encode, merge, pack, percentiles, quantile, summarise, unpack

RNG = np.random.default_rng(2)
CASES = {
    "normal": RNG.normal(size=60_000), "few": RNG.integers(0, 12, 30_000).astype(float), "heavy": -RNG.lognormal(0, 3, 30_000),
    "extreme": np.array([1e308, -1e308, 0.0, -0.0, 5e-324, 1.0]), "one": np.array([7.25]), "same": np.full(5000, 3.0),
}


def _off(values, share, got):
    s = np.sort(values)
    lo, hi = np.searchsorted(s, got - abs(got) * 2e-6 - 1e-300), np.searchsorted(s, got + abs(got) * 2e-6 + 1e-300, "right")
    return max(0, lo - share * len(s), share * len(s) - hi)


def test_encoding_keeps_order_and_decimals():
    v = np.sort(np.concatenate([CASES["normal"], CASES["extreme"]]))
    assert (np.diff(encode(v).astype(np.int64)) >= 0).all()
    assert [decode(int(encode(np.array([x]))[0])) for x in (0.0, 114.32, -18.5, 0.5664)] == [0.0, 114.32, -18.5, 0.5664]


@pytest.mark.parametrize("name", CASES)
def test_rank_error_of_merged_digests(name):
    k = math.ceil(DEPTH / 0.005)
    nodes, counts = [], []
    for part in np.array_split(CASES[name], 5):
        leaves, n = np.unique(encode(part) | np.uint64(1 << DEPTH), return_counts=True)
        a, b = compress(leaves, n, k)
        nodes.append(a)
        counts.append(b)
    nodes, counts = compress(np.concatenate(nodes), np.concatenate(counts), k)
    assert counts.sum() == len(CASES[name]) and len(nodes) <= 3 * k
    shares = [0.01, 0.25, 0.5, 0.9]
    for q, got in zip(shares, quantile(nodes, counts, shares)):
        assert _off(CASES[name], q, got) <= 0.005 * len(CASES[name]) + 1


def test_packed_digests_are_lossless():
    for nodes, counts in (([1], [1]), ([5, 6, 1 << 32, (1 << 33) - 1], [1, 300, 1 << 40, 1]), (range(10, 400), [1] * 390), ([7, 9], [2, 2])):
        a, b = unpack(pack(np.array(nodes, np.uint64), np.array(counts, np.int64)))
        assert a.tolist() == list(nodes) and b.tolist() == list(counts)


def test_days_summarised_apart_keep_the_bound(spark, monkeypatch):
    from pyspark.sql import functions as F

    import undertone.llm.quantiles as m

    monkeypatch.setattr(m, "FAN_IN", 3)
    monkeypatch.setattr(m, "BUFFER", 500)
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=30_000), np.full(5000, 0.25), rng.lognormal(size=15_000)])
    df = spark.createDataFrame([(f"d{i % 40}", float(v)) for i, v in enumerate(values)], "day string, x double").repartition(10)
    days = merge(summarise(df, "day", ["x"], 0.05), 0.05, df.rdd.getNumPartitions())
    rows = percentiles(merge(days.withColumn("key", F.lit("all")), 0.05), [0.01, 0.1, 0.5, 0.9, 0.99]).collect()
    assert all(r["n"] == len(values) and _off(values, r["share"], r["value"]) <= 0.05 * len(values) + 1 for r in rows) and len(rows) == 5


def test_spark_digests(spark):
    rows = [("a", float(x), None) for x in range(4000)] + [(None, 1.0, 2.0), (None, float("nan"), float("inf")), ("b", None, None)]
    df = spark.createDataFrame(rows, "key string, x double, y double").repartition(70)
    parts = df.rdd.getNumPartitions()
    out = {(r["key"], r["field"], r["share"]): (r["n"], r["value"]) for r in percentiles(merge(summarise(df, "key", ["x", "y"]), parts=parts), [0.5, 1.0]).collect()}
    assert out[None, "y", 0.5] == (1, 2.0) and out[None, "x", 1.0] == (1, 1.0)
    n, v = out["a", "x", 0.5]
    assert n == 4000 and abs(v - 2000) <= 21
    assert not any(k[0] == "b" for k in out)
    assert percentiles(merge(summarise(df.limit(0), "key", ["x"])), [0.5]).count() == 0
