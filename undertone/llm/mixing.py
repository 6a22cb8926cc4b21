"""Mixing sources to target weights in fixed-length blocks of tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.durable import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose token counts a worker remembers.
CACHE = 400_000
#: Shards whose running totals one window task sums up.
SHARDS_TOGETHER = 4096


class TokenCounter:
    """Token counts of texts: merges never cross pre-tokenizer pieces, so counts add up by piece."""

    def __init__(self, path: str = TOKENIZER):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pieces = regex.compile(PATTERN).findall
        self._known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        known, total = self._known, 0
        for piece in self._pieces(text):
            n = known.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece))
                if len(piece) <= 48:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(name: str) -> TokenCounter:
    """Counter of a shipped vocabulary, one per worker process."""
    return TokenCounter(SparkFiles.get(name))


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_counter(name)(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc", "source", "tokens"])

    return run


def draw(shard: int, slots: int, share: np.ndarray, seed: int) -> np.ndarray:
    """Source counts of one shard: a multinomial draw with one stratum per slot.

    Slot i falls to the source that holds a uniform number from i / slots to
    (i + 1) / slots, so every count has the mean of the plain draw and stays
    within two of it, however few the slots.
    """
    u = (np.arange(slots) + np.random.default_rng([seed, shard]).random(slots)) / max(slots, 1)
    return np.bincount(np.searchsorted(np.cumsum(share)[:-1], u, side="right"), minlength=len(share))


def _feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at ``x``: Feistel rounds on the next even power of two, walked back into range."""
    half = max(1, math.ceil(math.ceil(math.log2(max(n, 2))) / 2))
    mask = np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.ones(len(x), bool)
    while todo.any():
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(6):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (f >> np.uint64(32))) & mask
        out[todo] = left << np.uint64(half) | right
        todo = out >= n
    return out.astype(np.int64)


def _offsets(rows: DataFrame, group: str, order: Column, size: str, buckets: int) -> DataFrame:
    """Running totals ``start`` of ``size`` within ``group`` in the given 64-bit order.

    Rows are ranked within buckets of the order; the bucket totals, a few per
    group, are summed up separately. No task holds a whole group.
    """
    w = rows.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 64 - (buckets - 1).bit_length()) if buckets > 1 else F.lit(0).cast("long"))
    totals = w.groupBy(group, "_b").agg(F.sum(size).alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(group, "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_b").orderBy("_o", "doc")
    ranked = w.withColumn("_run", F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.join(before, [group, "_b"]).withColumn("start", F.col("_before") + F.col("_run") - F.col(size)).drop("_o", "_b", "_run", "_before")


def mix_sources(
    docs: DataFrame, doc: str, source: str, text: str, targets: list[tuple[str, float, int]], block: int = 1024, shard_blocks: int = 256, seed: int = 7, tokenizer: str = TOKENIZER
) -> DataFrame:
    """A mix in which each source has its target share of the tokens.

    The documents of a source, in a pseudorandom order, form one stream of tokens
    that is cut into blocks of ``block`` tokens (its last block may be shorter).
    The output is a row of shards of ``shard_blocks`` slots. The slots of a shard
    are dealt to the sources by one stratified multinomial draw of its own; the
    j-th slot that a source gets overall reads its block ``perm(j mod n)``, a
    permutation that is computed, not stored, and differs for every pass
    ``j div n``. So every block serves once before any serves again. The mix has
    as many slots as can be dealt before a source would need a block more than
    its ``max_repeats`` allows; its last shard may have fewer slots. The
    vocabulary file is shipped to the workers.

    ``targets`` holds (source, share, max_repeats), a small configuration: null
    sources and shares that are null or not positive are ignored, the rest is
    scaled to sum 1; a source without a token gets no slot and its share goes to
    the others in proportion. Null ids, sources or texts, empty texts and sources
    without a target are left out. Returns one row per use of a stretch of a
    document: ``(shard, slot, source, block, pass, doc, from_token, to_token)``.
    A repeated (id, source, text) row counts as a document of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = {s: (float(w), int(r or 1)) for s, w, r in targets if s is not None and w is not None and w > 0}
    base = docs.select(F.col(doc).cast("long").alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    base = base.where(F.col("doc").isNotNull() & F.col("source").isin(list(wanted)) & (F.length("text") > 0))
    spark.sparkContext.addFile(tokenizer)
    sized = scratch.save(base.mapInArrow(_count(Path(tokenizer).name), "doc long, source string, tokens long"))
    totals = {r["source"]: (r["docs"], r["tokens"]) for r in sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    names = [s for s in wanted if totals.get(s, (0, 0))[1]]
    n_blocks = {s: -(-totals[s][1] // block) for s in names}
    share = np.array([wanted[s][0] for s in names])
    share = share / share.sum() if names else share
    room = {s: n_blocks[s] * wanted[s][1] for s in names}
    # The draws of a source wander little, so a few shards more than the mean needs reach the end of the scarcest.
    shards = math.ceil(min((room[s] / p for s, p in zip(names, share)), default=0) / shard_blocks)
    most = shards + 2 + math.isqrt(shards)

    buckets = max(1, 1 << math.ceil(math.log2(max(1, sum(d for d, _ in totals.values()) / 100_000))))
    placed = _offsets(sized.where("tokens > 0"), "source", F.xxhash64("doc", "source", F.lit(seed)), "tokens", buckets)
    first, last = F.col("start"), F.col("start") + F.col("tokens") - 1
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block))))
    pieces = pieces.select(
        "source", "block", "doc",
        F.greatest(F.lit(0), F.col("block") * block - first).cast("long").alias("from_token"),
        F.least(F.col("tokens"), (F.col("block") + 1) * block - first).cast("long").alias("to_token"),
    )
    if not names:
        return pieces.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("slot"), "source", "block", F.lit(0).cast("long").alias("pass"), "doc", "from_token", "to_token").where("false")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            drawn = np.concatenate([draw(int(i), shard_blocks, share, seed) for i in ids]) if len(ids) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(names))), pa.array(names * len(ids), pa.string()), pa.array(drawn.astype(np.int64))], names=["shard", "source", "n"])

    dealt = scratch.save(spark.range(most).mapInArrow(deal, "shard long, source string, n long"))
    together = F.floor(F.col("shard") / SHARDS_TOGETHER)
    totals_so_far = Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("source", together.alias("_g")).agg(F.sum("n").alias("_t")).select("source", "_g", F.coalesce(F.sum("_t").over(totals_so_far), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy("source", "_g").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = dealt.withColumn("_g", together).withColumn("_own", F.sum("n").over(so_far)).join(before, ["source", "_g"])
    ranges = ranges.select("shard", "source", "n", (F.col("_before") + F.col("_own")).alias("upto"))
    limits = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(room[s]))])
    end = ranges.where(F.col("upto") > limits[F.col("source")]).agg(F.min("shard")).first()[0]
    used = ranges
    if end is not None:
        # The shard that would exceed a source is dealt again with as many slots as are left for all.
        left = {r["source"]: room[r["source"]] - r["upto"] + r["n"] for r in ranges.where(F.col("shard") == end).collect()}
        fits = (draw(end, m, share, seed) for m in range(shard_blocks, -1, -1))
        last = next(n for n in fits if all(c <= left[s] for s, c in zip(names, n)))
        rest = spark.createDataFrame([(end, s, int(c), room[s] - left[s] + int(c)) for s, c in zip(names, last)], "shard long, source string, n long, upto long")
        used = ranges.where(F.col("shard") < end).unionByName(rest)
    in_shard = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = used.withColumn("first_slot", in_shard).where("n > 0").select("shard", "source", "first_slot", F.posexplode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("at", "j"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = np.array(batch.column(1).to_pylist(), object)
            j = batch.column(4).to_numpy()
            slot = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            chosen, turn = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
            for k, s in enumerate(names):
                own = who == s
                turn[own] = j[own] // n_blocks[s]
                for t in np.unique(turn[own]):
                    now = own & (turn == t)
                    chosen[now] = _feistel(j[now] % n_blocks[s], n_blocks[s], seed * 1_000_003 + k * 1009 + int(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slot.astype(np.int64)), batch.column(1), pa.array(chosen), pa.array(turn)], names=["shard", "slot", "source", "block", "pass"])

    filled = slots.mapInArrow(pick, "shard long, slot long, source string, block long, pass long")
    return filled.join(pieces.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "block", "pass", "doc", "from_token", "to_token")
