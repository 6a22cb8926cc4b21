import os

import numpy as np
import pytest

from undertone.llm.mixing import TOKENIZER, TokenCounter, _feistel, mix_sources

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(_feistel(np.arange(n), n, 99).tolist()) == list(range(n))


def test_counts_equal_the_encoder():
    c = TokenCounter()
    for text in ("", "Hello  world's 123\n\n ça va? 日本", "x" * 300, " " * 40 + "end"):
        assert c(text) == len(c.encoding.encode_ordinary(text))


def _docs(spark):
    rows = [(i, ("a" if i % 3 else "b") if i % 17 else "c", "Word and note %d. " % i * (i % 23 + 1), 0, "s") for i in range(600)]
    rows += [(1000, None, "x", 0, ""), (1001, "a", None, 0, ""), (1002, "a", "", 0, ""), (None, "a", "x", 0, ""), (1003, "z", "no target", 0, "")]
    return spark.createDataFrame(rows, "id long, src string, text string, tokens int, source string")


def test_shares_repeats_and_whole_blocks(spark):
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.4, 1), (None, 0.1, 1)]
    rows = mix_sources(_docs(spark), "id", "src", "text", targets, block=16, shard_blocks=32).collect()
    use, total, slots = {}, {}, {}
    for r in rows:
        slots.setdefault((r["shard"], r["slot"]), set()).add((r["source"], r["block"], r["pass"]))
        for t in range(r["from_token"], r["to_token"]):
            use[r["doc"], t] = use.get((r["doc"], t), 0) + 1
        total[r["source"]] = total.get(r["source"], 0) + r["to_token"] - r["from_token"]
    assert all(len(v) == 1 for v in slots.values())
    assert set(total) == {"a", "b", "c"}
    limit = {"a": 1, "b": 2, "c": 3}
    src = {r["doc"]: r["source"] for r in rows}
    assert all(n <= limit[src[d]] for (d, _), n in use.items())
    whole = sum(total.values())
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(total[s] / whole - w) < 0.08
    assert all(len({(s, k) for s in range(32)}) == 32 for k in {k for k, _ in slots})


def test_many_buckets_give_one_stream(spark):
    from pyspark.sql import functions as F

    from undertone.llm.mixing import _offsets

    df = spark.range(500).select(F.col("id").alias("doc"), F.lit("s").alias("g"), (F.col("id") % 7 + 1).alias("n"))
    rows = sorted((r["start"], r["n"]) for r in _offsets(df, "g", F.xxhash64("doc"), "n", 8).collect())
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_empty(spark):
    df = _docs(spark)
    assert mix_sources(df.limit(0), "id", "src", "text", [("a", 1.0, 1)]).count() == 0
    assert mix_sources(df, "id", "src", "text", []).count() == 0


def test_draws_stay_near_their_mean():
    from undertone.llm.mixing import draw

    share = np.array([0.55, 0.3, 0.11, 0.04])
    counts = np.stack([draw(i, 64, share, 7) for i in range(400)])
    assert (counts.sum(1) == 64).all() and (np.abs(counts - 64 * share) < 2).all()
    assert (np.abs(counts.mean(0) - 64 * share) < 0.1).all() and len(np.unique(counts, axis=0)) > 1
    assert draw(0, 0, share, 7).sum() == 0


def test_little_data_gives_a_part_of_a_shard(spark):
    docs = spark.createDataFrame([(1, "a", "one two three"), (2, "b", "four five")], "id long, src string, text string")
    rows = mix_sources(docs, "id", "src", "text", [("a", 0.5, 1), ("b", 0.5, 1)]).collect()
    assert rows and {r["shard"] for r in rows} == {0} and len({r["doc"] for r in rows}) == len(rows)
