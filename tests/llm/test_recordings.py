import pytest

from undertone.llm.recordings import classify, order_minhash, parse_title, performers, same_recordings

SCHEMA = "id string, title string, artists string, ms long, a string, rep string"


def _pairs(spark, rows):
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    pairs, members = same_recordings(df, "id", "title", "artists", "ms")
    out = {(r["a"], r["b"]) for r in pairs.collect()}
    groups = {}
    for r in members.collect():
        groups.setdefault(r["rep"], set()).add(r["id"])
    return {(min(x, y), max(x, y)) for a, b in out | {(k, k) for k in groups} for x in groups[a] for y in groups[b] if x != y}


@pytest.mark.parametrize(
    "title, want",
    [
        ("Amber Nolito (feat. Zed) - 2004 Reissue", (["amber", "nolito"], "", "")),
        ("Amber Nolito [Karaoke Version] (Remastered 2011)", (["amber", "nolito"], "karaoke", "")),
        ("Amber Nolito, Pt. 3", (["amber", "nolito"], "", "3")),
        ("Amber Nolito III", (["amber", "nolito"], "", "3")),
        ("Amber Nolito - Live at Rail Hall", (["amber", "nolito"], "live at rail hall", "")),
        ("Nolito (Amber Kite)", (["nolito", "amber", "kite"], "", "")),
        ("Live", (["live"], "", "")),
    ],
)
def test_titles(title, want):
    assert parse_title(title) == want


def test_labels_and_performers():
    assert classify("Remastered 1999")[0] == "release"
    assert classify("Acousitc") == ("take", "acoustic")
    assert performers('"The Zeds" & Lú Ma feat. Ono') == ["luma", "ono", "zeds"]


def test_order_minhash_keeps_order():
    import numpy as np

    seeds = np.arange(1, 65, dtype=np.uint64) * np.uint64(77)
    same = (order_minhash("nolitokaramba", seeds) == order_minhash("nolitokaramba", seeds)).all()
    turned = (order_minhash("nolitokaramba", seeds) == order_minhash("karambanolito", seeds)).mean()
    assert same and turned < 1


def test_pairs(spark):
    rows = [
        ("1", "Amber Nolitoka", "Zed Marun", 200_000), ("2", "AMBER NOLITOKA (Deluxe Edition)", "zed marun & Ono", 201_000), ("3", "Nolitoka Amber", "Zed Marrun", None), ("4", "Ambér Nolitkoa", "Ono, Zed Marun", 199_000),
        ("5", "Amber Nolitoka - Live", "Zed Marun", 200_000), ("6", "Amber Nolitoka", "Quite Other", 200_000), ("7", "Amber Nolitoka, Pt. 2", "Zed Marun", 200_000), ("8", "Amber Nolitoka", "Zed Marun", 209_000),
        ("9", "Amber Nolitoka", None, 200_000), ("10", None, "Zed Marun", 200_000), ("11", " ", "Zed Marun", 1), ("1", "Amber Nolitoka", "Zed Marun", 200_000), (None, "Amber Nolitoka", "Zed Marun", 200_000),
        ("12", "Kelp " * 4000, "Long", 5), ("13", "Amber Nolitoka", "Zed Marun", 200_000),
    ]
    same = ["1", "13", "2", "3", "4"]
    want = {(min(x, y), max(x, y)) for x in same for y in same if x != y} | {("3", "8")}
    assert _pairs(spark, rows) == want
    assert _pairs(spark, []) == set()


def test_short_titles_with_a_slip_are_candidates(spark):
    titles = ["Velmora", "Velnora", "Kelpo", "Keplo", "Dunarim", "Dunarm", "Tosk", "Task", "Amberlit", "Abmerlit"]
    rows = [(f"{i:02}", t, f"Performer {chr(97 + i // 2) * 6}", 200_000) for i, t in enumerate(titles)]
    assert _pairs(spark, rows) == {(f"{i:02}", f"{i + 1:02}") for i in range(0, len(titles), 2)}


def test_titles_outside_ascii_are_kept(spark):
    rows = [("1", "Нолито Карамба", "Зед Марун", 200_000), ("2", "Нолито Карамбо", "Зед Марун", 200_500), ("3", "琥珀的风筝", "泽德", 180_000), ("4", "琥珀的风筝", "泽德", 180_100), ("5", "_ — !", "Зед", 1)]
    assert _pairs(spark, rows) == {("1", "2"), ("3", "4")}


def test_common_titles_meet_by_performer(spark, monkeypatch):
    import undertone.llm.recordings as m

    names = ["Zed Marun", "Ono Kalifa", "Brixle", "Tamora Quell"]
    rows = [(f"{i:03}", "Amber Nolitoka" if i % 3 else "Amber Nolitokka", names[i % 4] if i % 5 else names[i % 4].replace("a", "e", 1), None if i % 11 == 0 else 200_000 + i * 90) for i in range(60)]
    want = _pairs(spark, rows)
    monkeypatch.setattr(m, "COMMON_TITLE", 5)
    monkeypatch.setattr(m, "FEW_ROWS", 2)
    assert _pairs(spark, rows) == want and len(want) > 300


def test_long_titles_turn_at_any_word(spark):
    words = "kelp amber sonnet drift marble quarry velvet thistle ember glacier sparrow lantern meadow cobalt".split()
    rows = [(str(i), " ".join(words[i:] + words[:i]), "Zed Marun", 200_000) for i in (0, 5, 11)]
    assert len(_pairs(spark, rows)) == 3


def test_batched_sketches_equal_single_ones():
    import numpy as np

    from undertone.llm.recordings import order_minhashes

    seeds = np.arange(1, 9, dtype=np.uint64) * np.uint64(991)
    texts = ["a", "", "abab", "kelp" * 3000, "amber nolito", "åé日"]
    assert (order_minhashes(texts, seeds) == np.stack([order_minhash(t, seeds) for t in texts])).all()


def test_unlike_performers_make_no_candidates(spark, monkeypatch):
    from undertone.durable import Scratch

    saved, save = [], Scratch.save

    def counted(self, df):
        out = save(self, df)
        saved.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    names = [f"{a}{b}{c}" for a in ("Zedal", "Onkri", "Brixu", "Tamor") for b in "bdfgklmn" for c in ("osteli", "uvarni", "aquorp", "iphexo")]
    rows = [(f"{i:03}", f"The Lantern Parade {w}", n, 200_000) for i, (n, w) in enumerate(zip(names, reversed(names)))]
    assert ("x", "y") in _pairs(spark, [*rows, ("x", "The Lantern Parade Mimosa", "Quite Alone", 200_000), ("y", "The Lanten Parade Mimosa", "Quite Alone", 200_000)])
    assert max(saved) <= 4 * len(rows)


def test_near_names_share_a_key():
    import random

    from undertone.llm.recordings import most_slips, name_keys

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            fresh = [i]
            for j, y in enumerate(b, 1):
                fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
            row = fresh
        return row[-1]

    rng, near = random.Random(8), 0
    for _ in range(3000):
        one = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 7, 10, 13, 14, 18, 24, 32, 33, 40])))
        two = list(one)
        for _ in range(rng.randint(0, most_slips(len(one)))):
            at = rng.randrange(len(two))
            two[at : at + 1] = rng.choice([[], [rng.choice("abcdefgh")], [two[at], rng.choice("abcdefgh")]])
        short, long = sorted((one, "".join(two)), key=len)
        if len(short) >= 5 and distance(short, long) <= most_slips(len(long)):
            near += 1
            assert name_keys(short)[0] & name_keys(long)[1], (short, long)
    assert near > 2000


def test_common_titles_are_compared_as_rare_ones(spark):
    import random

    # Of a title of more than 2048 rows, performers of 20 letters six changes apart.
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(20)) for _ in range(24)]
    pairs = [(f"n{i:02}", n, "".join("q" if k % 3 == 1 and k < 18 else c for k, c in enumerate(n))) for i, n in enumerate(names)]
    few = [(f"{i}{s}", "Amber Nolitoka", n, 100_000 * k) for k, (i, *both) in enumerate(pairs, 1) for s, n in zip("ab", both)]
    many = [(f"m{i:04}", "Amber Nolitoka", f"{i:04}".translate(str.maketrans("0123456789", "ghjkpqvwxy")) * 4, 10_000_000 + 10_000 * i) for i in range(2100)]
    want = {(f"{i}a", f"{i}b") for i, _, _ in pairs}
    assert _pairs(spark, few) == want
    assert _pairs(spark, few + many) == want
