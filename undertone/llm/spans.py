"""Long verbatim spans shared between records, found through compact windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertone.durable import Scratch
from undertone.llm.components import hash_to_min
from undertone.skew import HOT_ROWS, hot_keys, split_join

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Signatures with more windows than this are joined by whole stretches instead of windows.
WIDE_BUCKET = 48
#: Characters hashed at a time.
SLICE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashes of all q-grams of texts, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        self._pow = np.ones(1, np.uint64)
        self._inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow) < n:
            size = max(n, 2 * len(self._pow))
            inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
            self._pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _STEP))])
            self._inv = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, inverse))])
        return self._pow[:n], self._inv[:n]

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        p, _ = self._powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) * _MULT + _STEP) * p[:-1], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, at: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Mixed hashes of the stretches from ``at`` up to ``end``, which depend on the content only."""
        _, inv = self._powers(len(prefix))
        return _mix((prefix[end] - prefix[at]) * inv[at])

    def all(self, text: str, q: int) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) < q:
            return np.empty(0, np.uint64)
        prefix = self.prefix(codes)
        return self.of(prefix, slice(0, len(codes) - q + 1), slice(q, None))


def compact_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Nodes ``(l, c, r)`` of the Cartesian tree over ``h`` that span at least ``width`` tokens.

    Every stretch of ``width`` or more tokens lies in exactly one node whose
    minimum, at ``c``, is the minimum of the stretch. Of equal minima the middle
    one splits, so that repetitive texts keep the tree shallow.
    """
    out, todo = [], [(0, len(h))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < width:
            continue
        part = h[lo:hi]
        c = int(part.argmin())
        if c + 1 < hi - lo and part[c] == part[c + 1]:
            same = np.flatnonzero(part == part[c])
            c = int(same[len(same) // 2])
        out.append((lo, lo + c, hi - 1))
        todo += [(lo, lo + c), (lo + c + 1, hi)]
    return out


def _texts(codes_of: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(first, last, codes, bounds)`` of consecutive texts with about SLICE characters."""
    i = 0
    while i < len(codes_of):
        j, n = i, 0
        while j < len(codes_of) and (j == i or n + len(codes_of[j]) <= SLICE):
            n += len(codes_of[j])
            j += 1
        codes = np.frombuffer("".join(codes_of[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, j, codes, np.cumsum([0] + [len(t) for t in codes_of[i:j]])
        i = j


def _windows(length: int, q: int):
    """Compact windows ``(id, sig, at, left, right)``: place of the minimum token and how far the window reaches.

    Where the minimum occurs more than once in a window, another text may hold the
    stretch around another occurrence, so both reaches are the whole window.
    """
    grams = Grams()
    width = length - q + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            who: list[int] = []
            sign: list[np.ndarray] = []
            places: list[tuple[int, int, int]] = []
            for i, j, codes, bounds in _texts(texts):
                prefix = grams.prefix(codes)
                h = grams.of(prefix, slice(0, max(0, len(codes) - q + 1)), slice(q, None)) if len(codes) >= q else np.empty(0, np.uint64)
                for k in range(j - i):
                    own = h[bounds[k] : max(bounds[k], bounds[k + 1] - q + 1)]
                    nodes = compact_windows(own, width)
                    if nodes:
                        who += [i + k] * len(nodes)
                        sign.append(own[[c for _, c, _ in nodes]])
                        for lo, c, hi in nodes:
                            once = np.count_nonzero(own[lo : hi + 1] == own[c]) == 1
                            places.append((c, c - lo, hi - c) if once else (c, hi - lo, hi - lo))
            at, left, right = zip(*places) if places else ((), (), ())
            values = np.concatenate(sign).view(np.int64) if sign else np.empty(0, np.int64)
            cols = [ids.take(pa.array(who, pa.int64())), pa.array(values), *(pa.array(v, pa.int32()) for v in (at, left, right))]
            yield pa.RecordBatch.from_arrays(cols, names=_WINDOW.names)

    return run


def _stretches(length: int, q: int, around: bool):
    """Hashes of stretches of ``length`` characters, as ``(id, at, gram)``.

    The third input column lists minimum tokens ``(at, left, right)``; the
    stretches lie in their windows and, with ``around``, hold the token.
    """
    grams = Grams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, where, found = [], [], []
            for k, (text, tokens) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                wanted = np.zeros(max(0, len(codes) - length + 1) + 1, np.int64)
                last = len(wanted) - 1
                for t in tokens:
                    lo, hi = t["at"] - t["left"], t["at"] + t["right"] + q - length
                    if around and t["left"] != t["right"]:
                        lo, hi = max(lo, t["at"] + q - length), min(hi, t["at"])
                    lo, hi = min(max(lo, 0), last), min(max(hi + 1, 0), last)
                    if lo < hi:
                        wanted[lo] += 1
                        wanted[hi] -= 1
                at = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                if len(at):
                    who += [k] * len(at)
                    where.append(at)
                    found.append(grams.of(grams.prefix(codes), at, at + length))
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            places = np.concatenate(where).astype(np.int64) if where else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(places), pa.array(values)], names=["id", "at", "gram"])

    return run


def _verify(length: int):
    """Exact check of candidate pairs on their texts."""
    grams = Grams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            last, ha = None, None
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last != (a, ta):
                    last, ha = (a, ta), grams.all(ta, length)
                hb = grams.all(tb, length)
                hits = np.flatnonzero(np.isin(hb, ha))
                if any(tb[i : i + length] == ta[j : j + length] for i in hits for j in np.flatnonzero(ha == hb[i])):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


_WINDOW = T.StructType([T.StructField("id", T.LongType()), T.StructField("sig", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("at", "left", "right"))])
_STRETCH = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "at", "gram")])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _base(docs: DataFrame, ident: str, text: str, length: int) -> DataFrame:
    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= length))


def _candidates(scratch: Scratch, base: DataFrame, length: int, q: int) -> tuple[DataFrame, DataFrame]:
    """``(copies, windows)``: exact copies, and the windows of first texts whose signature ``n`` windows have, n > 1."""
    digests = base.select("id", F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    reps = digests.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = scratch.save(digests.join(reps, "digest").select("id", "rep", "n"))
    signed = base.mapInArrow(_windows(length, q), _WINDOW).join(copies.where("id <> rep").select("id"), "id", "left_anti")
    signed = scratch.save(signed)
    sizes = scratch.save(signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    hot = hot_keys(sizes, "sig", "n", total) if (most or 0) > HOT_ROWS else []
    many = scratch.save(split_join(signed, sizes, "sig", hot))
    scratch.drop(signed)
    return copies, many


def _with_tokens(base: DataFrame, windows: DataFrame) -> DataFrame:
    tokens = windows.groupBy("id").agg(F.collect_list(F.struct("at", "left", "right")).alias("tokens"))
    return base.join(tokens, "id").select("id", "text", "tokens")


def shared_spans(docs: DataFrame, ident: str, text: str, length: int = 300) -> tuple[DataFrame, DataFrame]:
    """Records that share a verbatim span of ``length`` or more characters.

    Returns ``(links, copies)``. ``copies`` has ``(id, rep, n)``: exact copies of
    a text fold into the smallest id, n counts them. ``links`` has one row per
    pair of different texts that share a span, ``a < b`` being representatives.

    Tokens are the q-grams at every character, q two thirds of ``length``; any
    shared span holds the same ``length - q + 1`` tokens in both texts, hence
    lies in one compact window of each with the same minimum hash at the same
    place of the span. One hash function therefore loses nothing. Two windows of
    one signature are a candidate if, laid upon each other at their minima, they
    overlap in enough tokens. Signatures of many windows, as boilerplate has, are
    joined by the stretches of ``length`` characters around the minima instead,
    of which those held by the same set of records fold into one; so no bucket is
    capped, and boilerplate shorter than ``length`` brings no candidate at all.
    Candidates are verified on whole texts.

    Null ids and null, empty or short texts give no link and no copy row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spans")
    q = max(1, 2 * length // 3)
    base = _base(docs, ident, text, length)
    copies, many = _candidates(scratch, base, length, q)
    slim = many.where(F.col("n") <= WIDE_BUCKET)
    x = slim.select("sig", F.col("id").alias("a"), F.col("left").alias("left_a"), F.col("right").alias("right_a"))
    y = slim.select("sig", F.col("id").alias("b"), F.col("left").alias("left_b"), F.col("right").alias("right_b"))
    overlap = F.least("left_a", "left_b") + F.least("right_a", "right_b") + 1
    near = x.join(y, "sig").where("a < b").where(overlap >= length - q + 1).select("a", "b")

    wide = _with_tokens(base, many.where(F.col("n") > WIDE_BUCKET))
    held = scratch.save(wide.mapInArrow(_stretches(length, q, True), _STRETCH).select("id", "gram").distinct())
    sets = held.groupBy("gram").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("s")).where("n > 1")
    one = scratch.save(sets.groupBy("n", "x", "s").agg(F.min("gram").alias("gram")).select("gram", "n"))
    most, total = one.agg(F.max("n"), F.sum("n")).first()
    kept = scratch.save(split_join(held, one, "gram", hot_keys(one, "gram", "n", total) if (most or 0) > HOT_ROWS else []).select("id", "gram"))
    alike = kept.select("gram", F.col("id").alias("a")).join(kept.select("gram", F.col("id").alias("b")), "gram").where("a < b").select("a", "b")
    pairs = scratch.save(near.unionByName(alike).distinct())
    side = base.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    side = scratch.save(side)
    found = (
        pairs.join(side.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(side.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b").mapInArrow(_verify(length), _PAIR)
    )
    return scratch.save(found.distinct()), copies


def shared_cover(docs: DataFrame, ident: str, text: str, length: int = 300) -> DataFrame:
    """How much of every record stands elsewhere, without making pairs.

    One row per record that shares ``length`` or more characters with another:
    ``(id, rep, n_copies, passages, most_sharers, shared_chars)``. ``rep`` names
    its group of exact copies and ``n_copies`` counts the others in it,
    ``passages`` is the smallest record linked to it directly or through others
    by shared stretches, ``most_sharers`` counts the different texts that hold its
    most common stretch, ``shared_chars`` the characters in stretches that another
    record holds, all of them where there are copies.

    Candidate windows as in ``shared_spans``; their stretches are counted by
    content, so the work grows with what is shared, not with its pairs. Null ids
    and null, empty or short texts give no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "cover")
    q = max(1, 2 * length // 3)
    base = _base(docs, ident, text, length)
    copies, many = _candidates(scratch, base, length, q)
    grams = scratch.save(_with_tokens(base, many).mapInArrow(_stretches(length, q, False), _STRETCH).distinct())
    holders = grams.select("id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    holders = scratch.save(holders)
    most, total = holders.agg(F.max("n"), F.sum("n")).first()
    hot = hot_keys(holders, "gram", "n", total) if (most or 0) > HOT_ROWS else []
    shared = scratch.save(split_join(grams, holders, "gram", hot))
    before = F.lag("at").over(Window.partitionBy("id").orderBy("at"))
    fresh = shared.withColumn("fresh", F.least(F.lit(length), F.col("at") - F.coalesce(before, F.col("at") - length)))
    spans = fresh.groupBy("id").agg(F.max("n").alias("most_sharers"), F.sum("fresh").alias("covered"))
    linked = hash_to_min(shared.where("id <> first").select("id", "first").distinct(), "id", "first").toDF("id", "passages")
    sizes = base.select("id", F.length("text").cast("long").alias("size")).groupBy("id").agg(F.max("size").alias("size"))
    firsts = spans.join(linked, "id").withColumnRenamed("id", "rep")
    rows = copies.join(firsts, "rep", "left").where("n > 1 or covered is not null").join(sizes, "id")
    return rows.select(
        "id", "rep", (F.col("n") - 1).alias("n_copies"), F.coalesce("passages", "rep").alias("passages"), F.coalesce("most_sharers", F.lit(1)).alias("most_sharers"),
        F.when(F.col("n") > 1, F.col("size")).otherwise(F.col("covered")).alias("shared_chars"),
    )
