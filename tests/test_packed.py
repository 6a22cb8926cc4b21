import pytest

from undertone.operators.packed import Segmenter, split_packed

KNOWN = ["Lale & Sosu", "Skaf, the Rail", "folk, nordic", "Vem/Flep", "rock & roll", "folk"]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), ("", []), ("  ", []), ("Solo", ["Solo"]), ("A, B;C|D", ["A", "B", "C", "D"]), ("A feat. B feat. C", ["A", "B", "C"]), ("A (featuring B)", ["A", "B"]), ("A x B", ["A", "B"]),
        ("lale & sosu; Z", ["lale & sosu", "Z"]), ("Lale & Other", ["Lale", "Other"]), ('"Q, r" & \'S / t\'', ["Q, r", "S / t"]), ("O'Mara, D'Or", ["O'Mara", "D'Or"]), ('["r&b", "dub"]', ["r&b", "dub"]),
        ("bossa, folk, nordic, folk", ["bossa", "folk, nordic", "folk"]), ("A;Skaf, the Rail & B", ["A", "Skaf, the Rail", "B"]), ("a,,b; ;c", ["a", "b", "c"]), ("Vem/Flep/Z", ["Vem/Flep", "Z"]),
    ],
)
def test_segmenter(text, want):
    assert Segmenter(KNOWN).split(text) == want


def test_split_packed(spark):
    rows = [("1", "A & Lale & Sosu", 1), ("1", "A & Lale & Sosu", 1), ("2", "Solo", 1), ("3", None, 1), ("4", " ", 1), (None, "B, C", 1), ("5", "x, " * 3000 + "LALE & SOSU", 1), ("6", "Läle & Sosu feat. Z", 1)]
    df = spark.createDataFrame(rows, "id string, names string, pos int")
    known = spark.createDataFrame([(k, 0) for k in [*KNOWN, None, " "]], "name string, packed int")
    out = {}
    for r in split_packed(df, "id", "names", known, "name").collect():
        out.setdefault(r["record_id"], []).append((r["pos"], r["item"]))
    assert sorted(out["1"]) == [(1, "A"), (2, "Lale & Sosu")]
    assert sorted(out[None]) == [(1, "B"), (2, "C")] and out["2"] == [(1, "Solo")]
    assert max(out["5"]) == (3001, "LALE & SOSU") and "3" not in out and "4" not in out
    assert sorted(out["6"]) == [(1, "Läle & Sosu"), (2, "Z")]
    assert split_packed(df.limit(0), "id", "names", known, "name").count() == 0
    assert split_packed(df, "id", "names", known.limit(0), "name").where("record_id = '1'").count() == 3


def test_known_values_of_other_fields_do_not_count():
    cutter = Segmenter(["Rain, Steel & Co", "Kite, Zed"])
    assert cutter.split("Kite, Zed, Ono", ["Rain, Steel & Co"]) == ["Kite", "Zed", "Ono"]
    assert cutter.split("Kite, Zed, Ono", ["kite, zed"]) == cutter.split("Kite, Zed, Ono") == ["Kite, Zed", "Ono"]
