"""Evaluation texts inside a training corpus: rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertone.durable import Scratch

_WORD = re.compile(r"[^\W_]+")
#: Seeds up to this number ride along to the workers as an 8-byte array each (at
#: most 8 MB); beyond it, all corpus n-grams meet the seeds in a shuffle join.
CARRIED_SEEDS = 1_000_000
_P = np.uint64(0x100000001B3)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, case- and accent-insensitive."""
    if not text:
        return []
    text = text.casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text)


def gram_hashes(ws: list[str], n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    if len(ws) < n:
        return np.empty(0, np.uint64)
    crc = zlib.crc32
    h = np.array([crc(w.encode("utf-8", "surrogatepass")) | len(w) << 32 for w in ws], np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(len(ws) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _P
        out ^= out >> np.uint64(31)
    return out


#: Score of two equal words.
MATCH = 2.0


def align(item: list[str], doc: list[str], match: float = MATCH, mismatch: float = -1.0, gap: float = -1.0) -> tuple[float, int, int, int]:
    """Smith-Waterman over words: ``(score, doc_start, doc_end, longest run of equal words)``.

    Row by row over the item; gaps along the document by a running maximum, so
    each row is a handful of vector operations.
    """
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    d = np.array([ids.get(w, -1) for w in doc], np.int64)
    n = len(d)
    slope = np.arange(n + 1) * -gap
    h, start = np.zeros(n + 1), np.arange(n + 1)
    run = np.zeros(n + 1, np.int64)
    best, span, longest = 0.0, (0, 0), 0
    at = np.arange(n + 1)
    for w in item:
        eq = d == ids[w]
        run[1:] = np.where(eq, run[:-1] + 1, 0)
        longest = max(longest, int(run.max()))
        diag = h[:-1] + np.where(eq, match, mismatch)
        up = h[1:] + gap
        new = np.zeros(n + 1)
        from_diag = diag >= up
        new[1:] = np.where(from_diag, diag, up)
        origin = at.copy()
        origin[1:] = np.where(from_diag, start[:-1], start[1:])
        dead = new <= 0
        new[dead] = 0
        origin[dead] = at[dead]
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        src = np.maximum.accumulate(np.where(lifted >= top, at, 0))
        new, origin = top - slope, origin[src]
        origin = np.where(new <= 0, at, origin)
        new = np.maximum(new, 0)
        h, start = new, origin
        j = int(h.argmax())
        if h[j] > best:
            best, span = float(h[j]), (int(start[j]), j)
    return best, span[0], span[1], longest


_SEEN = T.StructType([T.StructField("doc", T.LongType()), T.StructField("gram", T.LongType())])
_SCORED = T.StructType(
    [T.StructField("doc", T.LongType()), T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType())]
    + [T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "longest_run", "item_words")]
)


def _grams(n: int, keep: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                g = gram_hashes(words(text), n)
                if keep is not None and len(g):
                    at = np.searchsorted(keep, g)
                    at[at == len(keep)] = 0
                    g = g[keep[at] == g] if len(keep) else g[:0]
                if len(g):
                    g = np.unique(g)
                    who += [k] * len(g)
                    found.append(g)
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(values)], names=["doc", "gram"])

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        last, dw = None, []
        for doc, item, dt, it in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if doc != last:
                last, dw = doc, words(dt)
            iw = words(it)
            score, a, b, longest = align(iw, dw)
            rows.append((doc, item, score, score / (MATCH * len(iw)), a, b, longest, len(iw)))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()] + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_SCORED.names)


def _rare_seeds(grams: list[tuple[int, int | None]], window: int) -> list[int]:
    """The rarest gram that occurs in the corpus of each run of ``window`` consecutive grams, or of all there are."""
    chosen = set()
    for i in range(max(1, len(grams) - window + 1)):
        held = [(n, g) for g, n in grams[i : i + window] if n]
        if held:
            chosen.add(min(held)[1])
    return sorted(chosen)


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, seed: int = 5, must: int = 8) -> DataFrame:
    """Candidate leaks with their alignment: one row per document and item that share a rare seed.

    Seeds are n-grams of ``seed`` folded words. Within every ``must`` consecutive
    words of an item, the n-gram that fewest documents, but one at least, contain is its seed, so a
    document with ``must`` consecutive item words always has a seed, while
    phrases common in the corpus bring no candidates. Shorter seeds and a smaller
    ``must`` reach copies that are edited more densely. Document frequencies count
    all documents. Each candidate is aligned over whole texts; columns are
    ``doc, item, score, share`` of the best possible score, the aligned words of
    the document, the ``longest_run`` of consecutive equal words, ``item_words``.

    Null ids or texts and texts without words give no rows; repeated rows count
    once; items shorter than ``seed`` words have no seed and cannot be found.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    corpus = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    tests = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("item_text")).where(F.col("item").isNotNull() & F.col("item_text").isNotNull()).distinct()

    def ordered(batches):
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                out.append(gram_hashes(words(t), seed).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["item", "grams"])

    listed = scratch.save(tests.mapInArrow(ordered, "item long, grams array<long>"))
    seeds = listed.select(F.explode("grams").alias("gram")).distinct()
    n_seeds = seeds.count()
    if n_seeds <= CARRIED_SEEDS:
        keep = np.sort(np.array([r[0] for r in seeds.toLocalIterator()], np.int64).view(np.uint64))
        seen = corpus.mapInArrow(_grams(seed, keep), _SEEN)
    else:
        seen = corpus.mapInArrow(_grams(seed), _SEEN).join(seeds, "gram")
    seen = scratch.save(seen)
    often = seen.groupBy("gram").agg(F.count_distinct("doc").alias("docs"))
    window = max(1, must - seed + 1)

    def rare(batches):
        for batch in batches:
            ids, out = [], []
            for i, gs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g in _rare_seeds([(x["gram"], x["docs"]) for x in sorted(gs, key=lambda x: x["pos"])], window):
                    ids.append(i)
                    out.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["item", "gram"])

    chosen = (
        listed.select("item", F.posexplode("grams").alias("pos", "gram")).join(often, "gram", "left")
        .groupBy("item").agg(F.collect_list(F.struct("pos", "gram", "docs")).alias("gs")).mapInArrow(rare, "item long, gram long")
    )
    pairs = scratch.save(seen.join(chosen, "gram").select("doc", "item").distinct())
    texts = corpus.join(pairs.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc", "text"])
    both = texts.join(pairs, "doc").join(tests, "item").select("doc", "item", "text", "item_text")
    # Alignment costs far more than its bytes suggest, so the rows are spread over all cores whatever their size.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(tasks, "doc").sortWithinPartitions("doc").mapInArrow(_score, _SCORED)
