"""Splitting fields that pack several values into one string.

A field such as ``A, B & C feat. "D, the E"`` is cut into its values by
dictionary-guided segmentation: an Aho-Corasick automaton over known whole
values marks the stretches of the field that are values as they stand, and a
dynamic programme picks the cover that keeps the most text inside known or
quoted values. Separators inside such values do not cut.

The dictionary is never broadcast. Only known values that contain a separator
can change a cut; each is sent by an equi-join on its first piece to the packed
strings that contain that piece, and every batch builds its automaton from the
entries that arrived with its own strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertone.functions.text import fold as fold_column

#: Separators between packed values, credit words, and quotes.
SEPARATORS = ",;/|&·•\t\n\r"
CREDITS = ("featuring", "feat", "ft")
CREDIT_TOKENS = ("x",)
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}

_CREDIT_WORD = r"(?:featuring|feat|ft)\b\.?"
_CUT = re.compile(
    r"[,;/|&·•\t\n\r]+|(?<!\w)[(\[]?\s*" + _CREDIT_WORD + r"|(?<=\s)[x×](?=\s)",
    re.IGNORECASE,
)
_LEAD_CREDIT = re.compile(r"^\s*[(\[]?\s*" + _CREDIT_WORD + r"\s*", re.IGNORECASE)
#: The same cuts for the JVM, used to find first pieces; keep in step with ``_CUT``.
_JVM_CUT = r"(?i)[,;/|&·•\t\n\r\"'“”«»()\[\]]+|(?<=^|[^\p{L}\p{N}])(?:featuring|feat|ft)(?![\p{L}\p{N}])\.?|(?<=\s)[x×](?=\s)"


def fold(text: str) -> str:
    """Case- and accent-insensitive form with one output character per input character."""
    out = []
    for ch in text:
        base = unicodedata.normalize("NFKD", ch)[:1].lower()[:1]
        out.append(base or ch)
    return "".join(out)


def _strip(item: str) -> str:
    """Drop blanks, enclosing quotes or brackets and leading credit words until nothing changes."""
    while True:
        before = item
        item = item.strip()
        item = _LEAD_CREDIT.sub("", item)
        if len(item) >= 2 and item[0] in QUOTES and item[-1] == QUOTES[item[0]] and QUOTES[item[0]] not in item[1:-1]:
            item = item[1:-1]
        elif len(item) >= 2 and item[0] in BRACKETS and item[-1] == BRACKETS[item[0]]:
            item = item[1:-1]
        elif item[:1] in BRACKETS and BRACKETS[item[0]] not in item:
            item = item[1:]
        elif item[-1:] in BRACKETS.values() and not any(o in item for o, c in BRACKETS.items() if c == item[-1]):
            item = item[:-1]
        if item == before:
            return item


def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans of quoted values: the opening quote starts a value, the closing one ends it."""
    spans, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch in QUOTES and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == ch)):
            j = i + 1
            while (j := text.find(QUOTES[ch], j)) > 0:
                if j + 1 >= len(text) or not text[j + 1].isalnum():
                    break
                j += 1
            if j > i + 1:
                spans.append((i, j + 1))
                i = j + 1
                continue
        i += 1
    return spans


class Segmenter:
    """Automaton over known values plus the dynamic programme that covers one field."""

    def __init__(self, known: Iterable[str]):
        self._automaton = ahocorasick.Automaton()
        self._any = False
        for value in known:
            if value:
                key = fold(value)
                self._automaton.add_word(key, key)
                self._any = True
        if self._any:
            self._automaton.make_automaton()

    def _protected(self, text: str, own: set[str] | None) -> list[tuple[int, int]]:
        """Stretches that are whole values: quoted ones and known ones, of ``own`` if given, between cuts."""
        spans = _quoted(text)
        if self._any:
            folded = fold(text)
            edges = [(m.start(), m.end()) for m in _CUT.finditer(text)]
            starts = {0} | {e for _, e in edges}
            ends = {len(text)} | {s for s, _ in edges}
            for end, key in self._automaton.iter(folded):
                if own is not None and key not in own:
                    continue
                a, b = end - len(key) + 1, end + 1
                left, right = a, b
                while left > 0 and left not in starts and (text[left - 1].isspace() or text[left - 1] in "\"'([{“«"):
                    left -= 1
                while right < len(text) and right not in ends and (text[right].isspace() or text[right] in "\"')]}”».,"):
                    if text[right] == ",":
                        break
                    right += 1
                if (left in starts or left == 0) and (right in ends or right == len(text) or text[right] in SEPARATORS):
                    spans.append((a, b))
        return spans

    def split(self, text: str | None, own: Iterable[str] | None = None) -> list[str]:
        """Values of one field in order; null, empty and blank fields give none.

        ``own`` limits the known values to those that count for this field, so that
        the result does not depend on what else the automaton holds.
        """
        if text is None or not text.strip():
            return []
        whole = text.strip()
        if len(whole) >= 2 and whole[0] == "[" and whole[-1] == "]":
            text = whole[1:-1]
        spans = self._protected(text, None if own is None else {fold(k) for k in own})
        cuts = [(m.start(), m.end()) for m in _CUT.finditer(text)]
        cover = _best_cover(len(text), spans)
        pieces, at = [], 0
        for a, b in cuts:
            if any(s < b and a < e for s, e in cover) or a < at:
                continue
            pieces.append(text[at:a])
            at = b
        pieces.append(text[at:])
        return [v for v in (_strip(p) for p in pieces) if any(c.isalnum() for c in v)]


def _best_cover(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the most characters, fewer spans on ties (weighted interval scheduling)."""
    ordered = sorted(set(spans), key=lambda s: (s[1], s[0]))
    best: list[tuple[int, int]] = [(0, 0)]
    back: list[tuple[int, bool]] = [(0, False)]
    ends = [s[1] for s in ordered]
    from bisect import bisect_right

    for k, (a, b) in enumerate(ordered, 1):
        p = bisect_right(ends, a, 0, k - 1)
        take = (best[p][0] + b - a, best[p][1] - 1)
        if take > best[k - 1]:
            best.append(take)
            back.append((p, True))
        else:
            best.append(best[k - 1])
            back.append((k - 1, False))
    out, k = [], len(ordered)
    while k:
        p, used = back[k]
        if used:
            out.append(ordered[k - 1])
        k = p
    return out[::-1]


_SPLIT = T.StructType([T.StructField("packed", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))])


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, known = batch.column("packed").to_pylist(), batch.column("known").to_pylist()
        cutter = Segmenter({k for ks in known if ks for k in ks})
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.string()), pa.array([cutter.split(p, k or ()) for p, k in zip(packed, known)], pa.list_(pa.string()))], names=["packed", "items"])


def _pieces(col):
    return F.filter(F.transform(F.split(fold_column(col), _JVM_CUT), lambda p: F.trim(p)), lambda p: p != "")


def split_packed(df: DataFrame, record: str, packed: str, known: DataFrame, value: str) -> DataFrame:
    """One row per value of a packed field, with its position counted from 1.

    Returns ``(record_id, pos, item, n_items)``. Rows whose field is null, empty
    or blank give nothing; equal records (same id and string) count once; a null
    record id is kept. ``known`` lists whole values in column ``value``; null and
    blank entries are ignored. Extra columns of either side are not read.
    """
    rows = df.select(F.col(record).cast("string").alias("record_id"), F.col(packed).alias("packed")).where(F.col("packed").rlike(r"\S")).distinct()
    strings = rows.select("packed").distinct()
    entries = (
        known.select(F.col(value).alias("entry")).where(F.col("entry").rlike(_JVM_CUT)).distinct()
        .withColumn("first", F.try_element_at(_pieces(F.col("entry")), F.lit(1))).where(F.col("first").isNotNull())
    )
    starts = strings.where(F.col("packed").rlike(_JVM_CUT)).select("packed", F.explode(F.array_distinct(_pieces(F.col("packed")))).alias("first"))
    hits = (
        starts.join(entries, "first")
        .where(F.contains(fold_column(F.col("packed")), fold_column(F.col("entry"))))
        .groupBy("packed").agg(F.collect_set("entry").alias("known"))
    )
    cut = strings.join(hits, "packed", "left").select("packed", "known").mapInArrow(_segment, _SPLIT)
    return (
        rows.join(cut, "packed")
        .select("record_id", F.size("items").cast("long").alias("n_items"), F.posexplode("items").alias("p", "item"))
        .select("record_id", (F.col("p") + 1).cast("long").alias("pos"), "item", "n_items")
    )
