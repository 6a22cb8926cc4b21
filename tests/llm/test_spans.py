import random

import numpy as np

from undertone.llm import spans
from undertone.llm.spans import Grams, compact_windows, shared_cover, shared_spans


def test_compact_windows_cover_every_stretch_once():
    rng = np.random.default_rng(3)
    for h in (rng.integers(0, 1 << 60, 300).astype(np.uint64), rng.integers(0, 5, 200).astype(np.uint64), np.zeros(150, np.uint64)):
        nodes = compact_windows(h, 40)
        for lo in range(0, len(h) - 40, 7):
            hold = [(a, c, b) for a, c, b in nodes if a <= lo and lo + 39 <= b and lo <= c <= lo + 39]
            assert len(hold) == 1 and h[hold[0][1]] == h[lo : lo + 40].min()


def test_grams_depend_on_content_only():
    g = Grams()
    a, b = g.all("xx" + "héllo wörld" + "y", 11), g.all("héllo wörld", 11)
    assert b[0] in a


def _brute(docs, n):
    seen = {}
    for i, t in docs:
        for p in range(len(t or "") - n + 1):
            seen.setdefault(t[p : p + n], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def _run(spark, docs, n):
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "id long, text string, rep int, n int")
    links, copies = shared_spans(df, "id", "text", n)
    groups = {}
    for r in copies.collect():
        groups.setdefault(r["rep"], set()).add(r["id"])
    pairs = {(r["a"], r["b"]) for r in links.collect()} | {(k, k) for k in groups}
    return {(min(x, y), max(x, y)) for a, b in pairs for x in groups[a] for y in groups[b] if x != y}


def _docs():
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcdefgh ijklmé\n") for _ in range(k))
    long, footer = text(60), text(38)
    docs = [(i, text(rng.randrange(0, 150)) + (long if i % 7 == 0 else "") + text(20) + (footer if i % 2 else "")) for i in range(120)]
    return docs + [(200, "ab" * 60), (201, "x" + "ab" * 40), (202, "ab" * 60), (203, None), (204, ""), (205, long[:39]), (206, "q" * 5000), (207, "q" * 41)]


def test_pairs_match_brute_force(spark):
    assert _run(spark, _docs(), 40) == _brute(_docs(), 40)


def test_wide_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spans, "WIDE_BUCKET", 2)
    assert _run(spark, _docs(), 40) == _brute(_docs(), 40)


def test_cover_matches_brute_force(spark):
    docs = _docs()
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "id long, text string, rep int, n int")
    got = {r["id"]: (r["rep"], r["n_copies"], r["passages"], r["most_sharers"], r["shared_chars"]) for r in shared_cover(df, "id", "text", 40).collect()}
    texts = {i: t for i, t in docs if len(t or "") >= 40}
    rep = {i: min(j for j, u in texts.items() if u == t) for i, t in texts.items()}
    holders = {}
    for i, t in texts.items():
        for p in range(len(t) - 39):
            holders.setdefault(t[p : p + 40], set()).add(rep[i])
    root = {i: i for i in texts}
    for group in [s for s in holders.values() if len(s) > 1]:
        low = min(root[i] for i in group)
        old = {root[i] for i in group}
        root = {i: low if r in old else r for i, r in root.items()}
    want = {}
    for i, t in texts.items():
        own = [p for p in range(len(t) - 39) if len(holders[t[p : p + 40]]) > 1]
        n = sum(rep[j] == rep[i] for j in texts)
        if own or n > 1:
            chars = len(t) if n > 1 else len({c for p in own for c in range(p, p + 40)})
            want[i] = (rep[i], n - 1, root[rep[i]], max([len(holders[t[p : p + 40]]) for p in own], default=1), chars)
    assert got == want


def test_empty(spark):
    assert _run(spark, [], 40) == set()
    assert shared_cover(spark.createDataFrame([], "id long, text string"), "id", "text", 40).count() == 0
