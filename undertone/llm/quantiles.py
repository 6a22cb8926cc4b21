"""Percentiles of large numeric columns by mergeable dyadic-tree digests (q-digest)."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Depth of the tree: values are ordered by the top 32 bits of their doubles,
#: which keeps 20 bits of mantissa (relative value error below 1e-6).
DEPTH = 32
#: Values buffered per digest before it is compressed again.
BUFFER = 1 << 17
#: Partial digests of a key and field that one merge task reads; it holds BUFFER nodes at most, however many there are.
FAN_IN = 1024
_HEAD = struct.Struct("<IQBB")


def encode(values: np.ndarray) -> np.ndarray:
    """Position of each finite double in the ordered universe of 2**32 leaves."""
    bits = (values + 0.0).astype(np.float64).view(np.uint64)
    ordered = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return (ordered >> np.uint64(64 - DEPTH)).astype(np.uint64)


def decode(leaf: int) -> float:
    """The decimal with the fewest digits that lies in a leaf."""
    ordered = (int(leaf) << (64 - DEPTH)) | (1 << (63 - DEPTH))
    bits = ordered & ((1 << 63) - 1) if ordered >> 63 else ~ordered & ((1 << 64) - 1)
    middle = float(np.array([bits], np.uint64).view(np.float64)[0])
    for value in [0.0, *(float(f"{middle:.{d}g}") for d in range(1, 18))]:
        if math.isfinite(value) and int(encode(np.array([value]))[0]) == int(leaf):
            return value
    return middle


def compress(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """q-digest of tree nodes: pairs of siblings that with their parent weigh at most n / k move up.

    Nodes are heap numbers (root 1, leaves 2**32 and on); equal nodes add up.
    """
    nodes, back = np.unique(nodes, return_inverse=True)
    counts = np.bincount(back, weights=counts.astype(np.float64)).astype(np.int64) if len(nodes) else counts[:0].astype(np.int64)
    limit = int(counts.sum()) // k
    if limit < 1:
        return nodes, counts
    bounds = np.searchsorted(nodes, np.array([1 << d for d in range(DEPTH + 2)], np.uint64))
    kept_nodes, kept_counts = [], []
    moved_n, moved_c = np.empty(0, np.uint64), np.empty(0, np.int64)
    for d in range(DEPTH, 0, -1):
        own_n, own_c = nodes[bounds[d] : bounds[d + 1]], counts[bounds[d] : bounds[d + 1]]
        level, inv = np.unique(np.concatenate([own_n, moved_n]), return_inverse=True)
        if not len(level):
            continue
        weight = np.zeros(len(level), np.int64)
        np.add.at(weight, inv, np.concatenate([own_c, moved_c]))
        parents, group = np.unique(level >> np.uint64(1), return_inverse=True)
        pair = np.zeros(len(parents), np.int64)
        np.add.at(pair, group, weight)
        up_n, up_c = nodes[bounds[d - 1] : bounds[d]], counts[bounds[d - 1] : bounds[d]]
        at = np.searchsorted(up_n, parents)
        has = at < len(up_n)
        has[has] = up_n[at[has]] == parents[has]
        total = pair.copy()
        total[has] += up_c[at[has]]
        rise = total <= limit
        stay = ~rise[group]
        kept_nodes.append(level[stay])
        kept_counts.append(weight[stay])
        moved_n, moved_c = parents[rise], pair[rise]
    if len(moved_n):
        kept_nodes.append(moved_n)
        kept_counts.append(moved_c)
    top = bounds[1]
    if top > bounds[0]:
        kept_nodes.append(nodes[bounds[0] : top])
        kept_counts.append(counts[bounds[0] : top])
    out, inv = np.unique(np.concatenate(kept_nodes), return_inverse=True)
    total = np.zeros(len(out), np.int64)
    np.add.at(total, inv, np.concatenate(kept_counts))
    return out, total


def pack(nodes: np.ndarray, counts: np.ndarray) -> bytes:
    """A digest as bytes: gaps of the sorted nodes and counts less one, byte plane by byte plane without the empty ones."""
    out, widths = [], []
    for v in (np.diff(nodes).astype(np.uint64), (counts - 1).astype(np.uint64)):
        width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
        widths.append(width)
        out.append(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return _HEAD.pack(len(nodes), int(nodes[0]), *widths) + out[0] + out[1]


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and counts of a packed digest."""
    n, first, *widths = _HEAD.unpack_from(body)
    at, parts = _HEAD.size, []
    for m, width in zip((n - 1, n), widths):
        wide = np.zeros((m, 8), np.uint8)
        wide[:, :width] = np.frombuffer(body, np.uint8, m * width, at).reshape(width, m).T
        parts.append(wide.view(np.uint64).ravel())
        at += m * width
    return np.cumsum(np.concatenate([np.array([first], np.uint64), parts[0]])).astype(np.uint64), parts[1].astype(np.int64) + 1


def quantile(nodes: np.ndarray, counts: np.ndarray, shares: list[float]) -> list[float]:
    """Values at the given shares: nodes in order of their last leaf, small ranges first."""
    depth = np.floor(np.log2(nodes.astype(np.float64))).astype(np.uint64)
    wrong = (nodes >> depth) == 0
    depth[wrong] -= np.uint64(1)
    span = np.uint64(DEPTH) - depth
    last = ((nodes + np.uint64(1)) << span) - np.uint64(1) - np.uint64(1 << DEPTH)
    order = np.lexsort((span, last))
    cum = np.cumsum(counts[order])
    n = int(cum[-1])
    at = np.searchsorted(cum, [max(1, math.ceil(s * n)) for s in shares])
    return [decode(int(last[order][i])) for i in at]


class _Partial:
    """Digests of one field for all keys of a partition, kept as ``key number << 33 | node``."""

    def __init__(self, k: int):
        self.k = k
        self.codes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._pending: list[np.ndarray] = []
        self._waiting = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self._pending.append(keys.astype(np.uint64) << np.uint64(DEPTH + 1) | np.uint64(1 << DEPTH) | encode(values))
        self._waiting += len(values)
        if self._waiting >= max(BUFFER, len(self.codes)):
            self.flush()

    def flush(self) -> None:
        if not self._waiting:
            return
        fresh, n = np.unique(np.concatenate(self._pending), return_counts=True)
        codes, inv = np.unique(np.concatenate([self.codes, fresh]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, inv, np.concatenate([self.counts, n]))
        self._pending, self._waiting = [], 0
        self.codes, self.counts = self._squeezed(codes, counts)

    def _squeezed(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = codes >> np.uint64(DEPTH + 1)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        heavy = np.flatnonzero(np.add.reduceat(counts, starts) >= self.k)
        if not len(heavy):
            return codes, counts
        ends = np.concatenate([starts[1:], [len(codes)]])
        keep = np.ones(len(codes), bool)
        more_codes, more_counts = [], []
        for g in heavy:
            a, b = starts[g], ends[g]
            keep[a:b] = False
            nodes, n = compress(codes[a:b] & np.uint64((1 << (DEPTH + 1)) - 1), counts[a:b], self.k)
            more_codes.append(nodes | keys[a] << np.uint64(DEPTH + 1))
            more_counts.append(n)
        return np.concatenate([codes[keep], *more_codes]), np.concatenate([counts[keep], *more_counts])


def _summarise(fields: list[str], k: int):
    """Digests of one partition, by group key; ``part`` numbers the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        numbers: dict[str | None, int] = {}
        partial = [_Partial(k) for _ in fields]
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            local = np.array([numbers.setdefault(v, len(numbers)) for v in keys.dictionary.to_pylist()] + [numbers.setdefault(None, len(numbers))], np.int64)
            codes = local[keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
            for f, own in enumerate(partial):
                values = batch.column(1 + f).fill_null(float("nan")).to_numpy(zero_copy_only=False)
                good = np.isfinite(values)
                own.add(codes[good], values[good])
        names = list(numbers)
        for f, own in enumerate(partial):
            own.flush()
            keys = own.codes >> np.uint64(DEPTH + 1)
            starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
            ends = np.append(starts[1:], len(keys))
            nodes = own.codes & np.uint64((1 << (DEPTH + 1)) - 1)
            yield from _digest_rows((names[int(keys[a])], fields[f], part, nodes[a:b], own.counts[a:b]) for a, b in zip(starts, ends))

    return run


def _digest_rows(digests: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of packed digests from ``(key, field, part, nodes, counts)``."""
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.binary()))], names=DIGEST.names)

    for key, field, part, nodes, counts in digests:
        body = pack(nodes, counts)
        rows.append((key, field, part, body))
        size += len(body)
        if size > 1 << 22 or len(rows) >= 5000:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _combine(k: int):
    """Add up digests whose rows arrive sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[tuple]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            now, waiting = None, 0
            for batch in batches:
                for *key, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if key != now:
                        if held:
                            yield *now, *_added(held, k)
                        now, held, waiting = key, [], 0
                    held.append(unpack(body))
                    waiting += len(held[-1][0])
                    if waiting > BUFFER and len(held) > 1:
                        held = [_added(held, k)]
                        waiting = 0
            if held:
                yield *now, *_added(held, k)

        yield from _digest_rows(merged())

    return run


def _added(digests: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    return compress(np.concatenate([n for n, _ in digests]), np.concatenate([c for _, c in digests]), k)


DIGEST = T.StructType([T.StructField("key", T.StringType()), T.StructField("field", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("body", T.BinaryType())])


def summarise(df: DataFrame, key: str, fields: list[str], rank_error: float = 0.005) -> DataFrame:
    """Packed digests ``(key, field, part, body)``, one per partition, key and field.

    ``df`` has the string column ``key`` and double columns ``fields``. Null, NaN
    and infinite values are not counted; a null key is a group of its own. A
    digest holds at most about three nodes per ``rank_error / 32`` of its values
    however many it has seen, so what leaves a partition is bounded.
    """
    return df.select(key, *fields).mapInArrow(_summarise(fields, _k(rank_error)), DIGEST)


def _k(rank_error: float) -> int:
    return math.ceil(DEPTH / rank_error)


def merge(digests: DataFrame, rank_error: float = 0.005, parts: int | None = None) -> DataFrame:
    """Digests of the same key and field combined into one by adding their nodes.

    With ``parts``, the number of partial digests, the merge is a tree: each task
    adds up at most FAN_IN digests, whose sizes are bounded, before the last step.
    """
    k = _k(rank_error)
    group = ["key", "field", "part"]

    def added(rows: DataFrame) -> DataFrame:
        return rows.select(*DIGEST.names).repartition(*group).sortWithinPartitions(*group).mapInArrow(_combine(k), DIGEST)

    out, left = digests, parts or 1
    while left > FAN_IN:
        left = math.ceil(left / FAN_IN)
        out = added(out.withColumn("part", F.pmod("part", F.lit(left)).cast("int")))
    return added(out.withColumn("part", F.lit(0)))


def percentiles(digests: DataFrame, shares: list[float]) -> DataFrame:
    """Values at ``shares`` of merged digests: ``(key, field, n, share, value)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, field, _, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                nodes, counts = unpack(body)
                rows += [(key, field, int(counts.sum()), q, v) for q, v in zip(shares, quantile(nodes, counts, shares))]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["key", "field", "n", "share", "value"])

    return digests.mapInArrow(read, "key string, field string, n long, share double, value double")
