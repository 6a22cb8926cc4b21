"""Similarity clusters of numeric records: MinHash banding over quantised cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertone.durable import Scratch
from undertone.llm.components import hash_to_min

#: Components brought to the driver at a time when the final groups are chosen, per wanted group.
HEAVIEST = 64
#: Cells of each loose part looked at in one round of its split.
PAGE = 64


def _bands(bands: int, rows: int):
    seeds = np.random.default_rng(11).integers(1, 1 << 62, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            levels = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            tokens = (levels + (1 << 20)).astype(np.uint64) | (np.arange(levels.shape[1], dtype=np.uint64) << np.uint64(32))
            keys = np.empty((n, bands), np.uint64)
            for b in range(bands):
                acc = np.full(n, b, np.uint64)
                for s in seeds[b * rows : (b + 1) * rows]:
                    h = (tokens ^ s) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    acc = (acc ^ (h ^ (h >> np.uint64(32))).min(1)) * np.uint64(0x94D049BB133111EB)
                    acc ^= acc >> np.uint64(31)
                keys[:, b] = acc
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), bands))), pa.array(keys.ravel().view(np.int64))], names=["cell", "key"])

    return run


def _distance2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def group_similar(rows: DataFrame, ident: str, vector: str, groups: int, similarity: float = 0.8, width: float = 1.0, bands: int = 20, band_rows: int = 8) -> tuple[DataFrame, DataFrame]:
    """``groups`` clusters of mutually similar vectors (components scaled to unit spread).

    Returns ``(members, medoids)``: ``(id, group, distance)`` for every record,
    distance being to the mean of its group, and ``(group, medoid, size)`` with a
    vector of the most connected cell.

    A record is the set of its levels, one per component, ``width`` wide. Equal
    sets fold into cells. MinHash bands propose pairs of cells, those with exact
    Jaccard of ``similarity`` or more are linked, and hash-to-min joins them into
    components. A component that is loose, wider than the distance within which
    groups lie, is split around its cells of highest degree. The heaviest parts
    that are not near to a heavier one become the groups, up to ``groups``; every
    other part goes whole to the nearest group.

    Null ids or vectors are left out; repeated rows count once; fewer separate
    parts than ``groups`` give fewer groups; no rows give no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "clusters")
    base = rows.select(F.col(ident).cast("string").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).distinct()
    base = scratch.save(base.withColumn("levels", F.transform("v", lambda x: F.floor(x / width + 0.5).cast("int"))).withColumn("cell", F.xxhash64("levels")))
    first = base.select(F.size("v")).first()
    if first is None or groups < 1:
        empty = base.select("id", F.lit(0).alias("group"), F.lit(0.0).alias("distance")).where("false")
        return empty, base.select(F.lit(0).alias("group"), F.col("v").alias("medoid"), F.lit(0).cast("long").alias("size")).where("false")
    dims = first[0]
    near = 0.5 * (2.0 * dims) ** 0.5
    sums = [F.sum(F.element_at("v", i + 1)).alias(f"s{i}") for i in range(dims)]
    norm = F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")
    cells = base.groupBy("cell").agg(F.count("*").alias("n"), F.first("levels").alias("levels"), norm, *sums)
    cells = scratch.save(cells.select("cell", "n", "levels", "norm", F.array(*[f"s{i}" for i in range(dims)]).alias("sum")))

    banded = cells.select("cell", "levels").mapInArrow(_bands(bands, band_rows), "cell long, key long")
    pairs = banded.select(F.col("cell").alias("a"), "key").join(banded.select(F.col("cell").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    side = cells.select("cell", "levels")
    equal = F.aggregate(F.zip_with("levels_a", "levels_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    linked = (
        pairs.join(side.toDF("a", "levels_a"), "a").join(side.toDF("b", "levels_b"), "b")
        .withColumn("same", equal).where(F.col("same") >= similarity * (2 * dims - F.col("same"))).select("a", "b")
    )
    linked = scratch.save(linked)
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(cells.select(F.col("cell").alias("b"), "n"), "b").groupBy(F.col("a").alias("cell")).agg(F.sum("n").alias("degree"))
    parts = hash_to_min(linked, "a", "b").toDF("cell", "part")
    state = cells.join(parts, "cell", "left").join(degree, "cell", "left").withColumn("part", F.coalesce("part", "cell")).withColumn("degree", F.col("n") + F.coalesce("degree", F.lit(0)))
    state = scratch.save(state.withColumn("mean", F.transform("sum", lambda x: x / F.col("n"))))
    state = _split_loose(scratch, state, dims, near)

    total = [F.sum(F.element_at("sum", i + 1)).alias(f"s{i}") for i in range(dims)]
    best = F.max_by("mean", F.struct("degree", "cell")).alias("medoid")
    whole = state.groupBy("part").agg(F.sum("n").alias("n"), best, *total)
    whole = scratch.save(whole.select("part", "n", "medoid", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dims)]).alias("mean")))
    chosen: list = []
    # Parts near to a chosen one are left out of the next page, so there are at most ``groups`` pages.
    page = whole.orderBy(F.desc("n"), "part").limit(HEAVIEST * groups).collect()
    while page and len(chosen) < groups:
        for r in page:
            if len(chosen) < groups and all(sum((x - y) ** 2 for x, y in zip(r["mean"], c["mean"])) ** 0.5 > near for c in chosen):
                chosen.append(r)
        n, part = page[-1]["n"], page[-1]["part"]
        left = whole.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("part") > part)))
        for c in chosen:
            left = left.where(F.sqrt(_distance2(F.col("mean"), F.array(*[F.lit(x) for x in c["mean"]]))) > near)
        page = left.orderBy(F.desc("n"), "part").limit(HEAVIEST * groups).collect() if len(chosen) < groups else []
    centre = F.array(*[F.struct(_distance2(F.col("mean"), F.array(*[F.lit(x) for x in c["mean"]])).alias("d"), F.lit(g).alias("group")) for g, c in enumerate(chosen)])
    named = scratch.save(whole.select("part", F.array_min(centre)["group"].alias("group")))
    where = scratch.save(state.select("cell", "part").join(named, "part").select("cell", "group"))
    placed = base.select("id", "v", "cell").join(where, "cell").select("id", "v", "group")
    middle = placed.groupBy("group").agg(F.count("*").alias("size"), F.array(*[F.avg(F.element_at("v", i + 1)) for i in range(dims)]).alias("middle"))
    middle = scratch.save(middle)
    medoid = spark.createDataFrame([(g, [float(x) for x in c["medoid"]]) for g, c in enumerate(chosen)], "group int, medoid array<double>")
    members = placed.join(F.broadcast(middle), "group").select("id", "group", F.sqrt(_distance2(F.col("v"), F.col("middle"))).alias("distance"))
    return scratch.save(members), medoid.join(middle, "group").select("group", "medoid", "size")


def _split_loose(scratch: Scratch, state: DataFrame, dims: int, near: float, page: int = PAGE) -> DataFrame:
    """Split every part whose spread exceeds what one group has around its best connected cells.

    The cell of highest degree that is farther than ``near`` from all seats gets
    a seat, until there is none; a round looks at ``page`` such cells of each part.
    """
    shape = state.groupBy("part").agg(F.sum("n").alias("n"), F.sum("norm").alias("norm"), *[F.sum(F.element_at("sum", i + 1)).alias(f"s{i}") for i in range(dims)])
    mean2 = sum((F.col(f"s{i}") / F.col("n")) ** 2 for i in range(dims))
    loose = scratch.save(shape.where(F.col("norm") / F.col("n") - mean2 > (0.6 * near) ** 2).select("part"))
    if loose.isEmpty():
        return state
    rest = state.join(loose, "part", "left_anti")
    split = scratch.save(state.join(loose, "part").withColumn("best", F.lit(float("inf"))).withColumn("seat", F.col("part")))
    order = Window.partitionBy("part").orderBy(F.desc("degree"), F.desc("cell"))
    schema = T.StructType([split.schema["part"], T.StructField("seats", T.ArrayType(T.StructType([split.schema["cell"], split.schema["mean"]])))])

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells in batch.column(1).to_pylist():
                kept: list = []
                for c in sorted(cells, key=lambda c: c["r"]):
                    if all(sum((x - y) ** 2 for x, y in zip(c["mean"], k["mean"])) ** 0.5 > near for k in kept):
                        kept.append({"cell": c["cell"], "mean": c["mean"]})
                out.append(kept)
            kind = pa.list_(pa.struct([("cell", pa.int64()), ("mean", pa.list_(pa.float64()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["part", "seats"])

    while True:
        far = split.where(F.col("best") > near).withColumn("r", F.row_number().over(order)).where(F.col("r") <= page)
        fresh = scratch.save(far.groupBy("part").agg(F.collect_list(F.struct("r", "cell", "mean")).alias("cells")).mapInArrow(seats, schema))
        if fresh.isEmpty():
            break
        nearest = F.array_min(F.transform("seats", lambda m, i: F.struct(F.sqrt(_distance2(F.col("mean"), m["mean"])).alias("d"), i.alias("i"), m["cell"].alias("cell"))))
        joined = split.join(fresh, "part", "left").withColumn("m", nearest)
        closer = F.col("m").isNotNull() & (F.col("m.d") < F.col("best"))
        old, split = split, scratch.save(joined.withColumn("seat", F.when(closer, F.col("m.cell")).otherwise(F.col("seat"))).withColumn("best", F.when(closer, F.col("m.d")).otherwise(F.col("best"))).drop("m", "seats"))
        scratch.drop(old)
    split = split.withColumn("part", F.col("seat")).drop("best", "seat")
    return scratch.save(rest.unionByName(split))
