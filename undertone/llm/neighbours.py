"""Most similar vectors for every vector: robust-pruned directed graphs over shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertone.durable import Scratch

#: Vectors that fix the shards; a documented bound, every vector is indexed.
SAMPLE = 40_000
#: Shards at most, so that the centres that travel with every task stay small.
MOST_SHARDS = 4096
#: Queries searched together.
BATCH = 768


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of many queries at once: ids and squared distances of the best ``width``.

    ``graph`` lists out-neighbours, -1 where there are fewer. Each step opens the
    ``expand`` best unopened nodes of every beam until none is left.
    """
    n = len(queries)
    ids = np.full((n, width), -1, np.int32)
    dist = np.full((n, width), np.inf, np.float32)
    opened = np.zeros((n, width), bool)
    seen = np.zeros((n, len(points)), bool)
    ids[:, 0] = start
    dist[:, 0] = ((points[start] - queries) ** 2).sum(1)
    seen[:, start] = True
    active = np.arange(n)
    while len(active):
        d = np.where(opened[active], np.inf, dist[active])
        pick = np.argpartition(d, expand - 1, axis=1)[:, :expand] if expand < width else np.tile(np.arange(width), (len(active), 1))
        live = np.isfinite(np.take_along_axis(d, pick, 1))
        some = live.any(1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        rows = active[:, None]
        opened[rows, pick] = True
        near = graph[np.where(live, ids[rows, pick], 0)]
        near = np.where(live[:, :, None], near, -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[rows, near]
        near = np.where(fresh, near, -1)
        order = np.sort(near, axis=1)
        twice = np.zeros(order.shape, bool)
        twice[:, 1:] = order[:, 1:] == order[:, :-1]
        near = np.where(twice, -1, order)
        ok = near >= 0
        # The last column of -1 entries marks a node that is masked again below.
        who, col = np.nonzero(ok)
        found = near[who, col]
        seen[active[who], found] = True
        nd = np.full(near.shape, np.inf, np.float32)
        diff = points[found] - queries[active[who]]
        nd[who, col] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[active], nd], axis=1)
        all_i = np.concatenate([ids[active], near], axis=1)
        all_o = np.concatenate([opened[active], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[active] = np.take_along_axis(all_d, best, 1)
        ids[active] = np.take_along_axis(all_i, best, 1)
        opened[active] = np.take_along_axis(all_o, best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(points: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Out-neighbours of ``own`` from candidates (-1 where fewer): nearest first, dropping every
    candidate that a kept one is ``relax`` times closer to than the point is."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand = np.where(cand == own[:, None], -1, cand)
    x = points[np.maximum(cand, 0)]
    d = ((x - points[own][:, None]) ** 2).sum(2)
    d[cand < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    x = np.take_along_axis(x, order[:, :, None], 1)
    sq = (x * x).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        p = alive.argmax(1)
        out[some, k] = cand[some, p[some]]
        alive &= ~(relax * relax * between[rows, p] <= d)
        alive[rows, p] = False
    return out


def build_graph(points: np.ndarray, degree: int = 24, width: int = 40, relax: float = 1.2, seed: int = 3) -> tuple[np.ndarray, int]:
    """Robust-pruned graph over ``points`` by batch insertion in random order, each batch at most as
    large as what is already there; returns ``(graph, entry point)``."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    # The entry point comes first: the point nearest to the mean.
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int32)
    done = min(n, width)
    first = order[:done]
    graph[first] = robust_prune(points, first, np.tile(first, (done, 1)), degree, relax)
    while done < n:
        batch = order[done : done + min(done, BATCH)]
        near, _ = beam_search(points, graph, entry, points[batch], width)
        graph[batch] = robust_prune(points, batch, near, degree, relax)
        src = np.repeat(batch, degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, starts, counts = np.unique(dst, return_index=True, return_counts=True)
        pad = np.full((len(nodes), int(counts.max())), -1, np.int32)
        pad[np.repeat(np.arange(len(nodes)), counts), np.arange(len(dst)) - np.repeat(starts, counts)] = src
        merged = np.concatenate([graph[nodes], pad], axis=1)
        fits = (merged >= 0).sum(1) <= degree
        if fits.any():
            graph[nodes[fits]] = -np.sort(-merged[fits], axis=1)[:, :degree]
        for at in range(0, int((~fits).sum()), BATCH):
            part = np.flatnonzero(~fits)[at : at + BATCH]
            wide = -np.sort(-merged[part], axis=1)
            wide = wide[:, : max(degree, int((wide >= 0).sum(1).max()))]
            graph[nodes[part]] = robust_prune(points, nodes[part].astype(np.int32), wide, degree, relax)
        done += len(batch)
    return graph, entry


def balanced_centres(sample: np.ndarray, shards: int, seed: int = 5) -> np.ndarray:
    """Centres of about equal shares of the sample, by repeated halving."""
    rng = np.random.default_rng(seed)
    most = max(1, math.ceil(len(sample) / shards))
    todo, leaves = [np.arange(len(sample))], []
    while todo:
        own = todo.pop()
        if len(own) <= most * 1.4 or len(own) < 4:
            leaves.append(own)
            continue
        x = sample[own]
        c = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(8):
            side = ((x - c[0]) ** 2).sum(1) - ((x - c[1]) ** 2).sum(1)
            left = side <= np.median(side)
            if left.all() or not left.any():
                break
            c = np.stack([x[left].mean(0), x[~left].mean(0)])
        if left.all() or not left.any():
            leaves.append(own)
        else:
            todo += [own[left], own[~left]]
    return np.stack([sample[v].mean(0) for v in leaves])


def _scale_of(sample: np.ndarray, home: np.ndarray, shards: int, k: int, n: int) -> np.ndarray:
    """Typical distance to the k-th neighbour in each shard, from the sample, scaled to ``n`` vectors."""
    rng = np.random.default_rng(9)
    probe = rng.choice(len(sample), min(1500, len(sample)), replace=False)
    sq = (sample**2).sum(1)
    kth = np.empty(len(probe))
    for at in range(0, len(probe), 250):
        p = probe[at : at + 250]
        d = sq[p][:, None] + sq[None] - 2 * sample[p] @ sample.T
        kth[at : at + 250] = np.sqrt(np.maximum(np.partition(d, min(k, len(sample) - 1), axis=1)[:, min(k, len(sample) - 1)], 0))
    spread = float(np.median(kth)) if len(kth) else 0.0
    out = np.array([np.median(kth[home[probe] == s]) if (home[probe] == s).any() else spread for s in range(shards)])
    return out * (len(sample) / max(n, 1)) ** (1 / sample.shape[1])


def nearest_vectors(vectors: DataFrame, ident: str, vector: str, k: int = 5, shard_size: int = 16_000, reach: float = 0.6, width: int = 40) -> DataFrame:
    """The ``k`` nearest other vectors of each vector by Euclidean distance: ``(id, neighbour, distance)``.

    Every vector is indexed in the shard of its nearest centre; the centres halve
    a sample of at most SAMPLE vectors. Each shard gets a robust-pruned graph and
    is searched by all vectors that lie in it or whose distance to its border is
    under ``reach`` times the usual distance to a k-th neighbour around them.
    Approximate: recall is measured in the tests. Equal vectors fold into one
    representative before indexing, of which the k + 1 smallest ids stand in
    results, so groups of copies of any size are exact. Ties in distance go to the
    smaller id.

    Rows with a null id or vector, or with null or non-finite components, are left
    out; all vectors must have one length. Fewer than two vectors give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(F.col(ident).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38))
    rows = scratch.save(rows.where(usable).distinct())
    reps = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = scratch.save(reps)
    n = reps.count()
    if n == 0:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")).where("false")
    share = min(1.0, 1.2 * SAMPLE / n)
    sample = np.array([r[0] for r in reps.select("v").where(F.abs(F.xxhash64("rep") % 1_000_003) < share * 1_000_003).limit(SAMPLE).collect()] or [reps.first()["v"]], np.float32)
    shards = min(MOST_SHARDS, max(1, math.ceil(n / shard_size)))
    centres = balanced_centres(sample, shards)
    home = ((centres**2).sum(1)[None] - 2 * sample @ centres.T).argmin(1)
    margin = reach * _scale_of(sample, home, len(centres), k, n)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 1e-12))

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            d = (x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T
            own = d.argmin(1)
            at = np.arange(len(x))
            border = (d - d[at, own][:, None]) / (2 * apart[own])
            border[at, own] = -1
            row, shard = np.nonzero(border <= margin[own][:, None])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), lists.take(take), pa.array(shard.astype(np.int32)), pa.array(own[row] == shard)], names=["rep", "v", "shard", "own"])

    routed = reps.select("rep", "v").mapInArrow(route, "rep string, v array<float>, shard int, own boolean")

    def search(shard: pa.Table) -> pa.Table:
        own = shard.column("own").to_numpy()
        x = np.ascontiguousarray(shard.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(shard.num_rows, -1), np.float32)
        inside = np.flatnonzero(own)
        if not len(inside):
            return pa.table({"rep": pa.array([], pa.string()), "near": pa.array([], pa.string()), "d": pa.array([], pa.float64())})
        points = np.ascontiguousarray(x[inside])
        graph, entry = build_graph(points)
        want = min(k + 1, len(points))
        w = max(min(width, len(points)), want)
        near, dist = [], []
        for at in range(0, len(x), BATCH):
            i, d = beam_search(points, graph, entry, x[at : at + BATCH], w)
            near.append(i[:, :want])
            dist.append(d[:, :want])
        near, dist = np.concatenate(near), np.concatenate(dist)
        row, col = np.nonzero(near >= 0)
        reps_here = shard.column("rep")
        found = pa.table({"rep": reps_here.take(pa.array(row)), "near": reps_here.take(pa.array(inside[near[row, col]])), "d": pa.array(np.sqrt(dist[row, col].astype(np.float64)))})
        return found.combine_chunks()

    hits = scratch.save(routed.groupBy("shard").applyInArrow(search, "rep string, near string, d double").where("rep <> near").distinct())
    best = Window.partitionBy("rep").orderBy("d", "near")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("rep", "near", "d")
    hits = scratch.save(hits)
    copies = reps.where("n > 1").select("v", "rep")
    first = Window.partitionBy("v").orderBy("id")
    stand = rows.join(copies, "v", "left_semi").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).join(reps.select("v", "rep"), "v").select("rep", F.col("id").alias("member"))
    stand = scratch.save(stand)
    member = rows.join(reps.select("v", "rep"), "v").select("id", "rep")
    links = hits.unionByName(copies.select("rep", F.col("rep").alias("near"), F.lit(0.0).alias("d")))
    spelled = links.join(stand.withColumnRenamed("rep", "near"), "near", "left").select("rep", F.coalesce("member", "near").alias("neighbour"), F.col("d").alias("distance"))
    out = member.join(spelled, "rep").where(F.col("id") != F.col("neighbour"))
    rank = Window.partitionBy("id").orderBy("distance", "neighbour")
    return out.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).select("id", "neighbour", "distance")
