import pytest

from undertone.llm.leaks import align, find_leaks, words


def test_words_fold():
    assert words("Café—“NAÏVE” 12x\n_ok") == ["cafe", "naive", "12x", "ok"]


@pytest.mark.parametrize(
    "doc, score, run", [("a b c d e f", 12, 6), ("x a b c d e f y", 12, 6), ("a b c z d e f", 11, 3), ("a b d e f", 9, 3), ("z", 0, 0), ("", 0, 0)]
)
def test_alignment(doc, score, run):
    got = align("a b c d e f".split(), doc.split())
    assert (got[0], got[3]) == (score, run)


def _run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item long")
    i = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc string")
    return {(r["doc"], r["item"]): r["longest_run"] for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()}


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"intro {item.upper()} outro"), (2, "say: thrée, four\nfive; six “seven” eight nine ten!"), (3, "one two three four five and more"), (4, None), (5, ""), (6, "nothing"), (1, f"intro {item.upper()} outro"), (None, item), (7, "w " * 20000 + item)]
    items = [(10, item), (11, None), (12, ""), (13, "one two three"), (10, item), (None, item)]
    got = _run(spark, docs, items)
    assert got == {(1, 10): 12, (2, 10): 8, (3, 10): 5, (7, 10): 12} or got == {(1, 10): 12, (2, 10): 8, (7, 10): 12}
    assert _run(spark, [], items) == {} and _run(spark, docs, []) == {}


def test_seeds_beyond_the_carried_bound(spark, monkeypatch):
    import undertone.llm.leaks as m

    monkeypatch.setattr(m, "CARRIED_SEEDS", 0)
    test_leaks(spark)


def test_documents_outside_ascii_are_searched(spark):
    item = "раз два три четыре пять шесть семь восемь девять десять"
    assert _run(spark, [(1, f"ну {item.upper()}"), (2, "— !")], [(10, item)]) == {(1, 10): 10}


def test_edited_copies_are_found_by_their_score(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, [word() for _ in range(24)]) for i in range(40)]
    docs = []
    for i, ws in items:
        edited = list(ws)
        for at in range(rng.randrange(4), len(ws), 4):  # no five words in a row stay
            edited[at] = word()
        docs.append((i, " ".join([word() for _ in range(60)] + edited + [word() for _ in range(60)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")

    def found(**kw):
        rows = find_leaks(d, "doc_id", "text", t, "item_id", "text", **kw).where("share >= 0.6").collect()
        assert all(r["doc"] == r["item"] and 60 <= r["first_word"] <= r["last_word"] <= 85 for r in rows)
        return len({r["item"] for r in rows})

    assert found(seed=3, must=5) >= 0.95 * len(items) and found() == 0
