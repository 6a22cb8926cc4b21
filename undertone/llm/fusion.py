"""Best representative of each duplicate group by iterative truth discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.durable import Scratch


def has_value(col: Column, dtype: str) -> Column:
    """Null, empty and blank are no value; NaN is none for floating columns."""
    if dtype == "string":
        return col.isNotNull() & col.rlike(r"[^\s\x{00a0}]")
    if dtype in ("double", "float"):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def best_graded(claims: DataFrame, group: str, record: str, fields: list[str], grade: list[Column]) -> DataFrame:
    """``(group, field_name, record)``: per group and field the record of the best grade that has a value.

    ``grade`` lists ascending sort keys; remaining ties go to the smaller record
    id, so the order is total and no votes are taken. Null groups and records are
    dropped; a field that no member fills has no row.
    """
    types = dict(claims.dtypes)
    order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(grade)], F.col(record).cast("string").alias("id"))
    filled = F.filter(F.array(*[F.when(has_value(F.col(f), types[f]), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    offers = claims.where(F.col(group).isNotNull() & F.col(record).isNotNull()).select(F.col(group).alias("g"), order.alias("grade"), F.explode(filled).alias("field_name"))
    return offers.groupBy("g", "field_name").agg(F.min("grade").alias("best")).select(F.col("g").alias(group), "field_name", F.col("best.id").alias(record))


def discover_truth(
    claims: DataFrame,
    group: str,
    record: str,
    source: str,
    fields: list[str],
    trust: list[Column] | None = None,
    tolerance: float = 1e-3,
    max_rounds: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """Choose one value per group and field; returns ``(truths, reliability)``.

    Each record claims its fields' values for its group. The rounds alternate
    between (a) the support of a value, the sum of the reliabilities of the
    sources that claim it, and (b) the reliability of a source per field, the
    smoothed share of its claims that carry the value chosen in (a), until no
    reliability moves by more than ``tolerance``. Past a third of ``max_rounds``
    the step is halved, which ends any swing between two choices; a run that has
    not settled by ``max_rounds`` raises. ``trust`` is an optional list
    of ascending sort keys that grades the claims: a value claimed by a better
    graded record outranks any vote of worse graded ones, so the iterated votes
    decide only among values of equal grade. Without ``trust`` they decide alone.
    Remaining ties go to the smaller record id, then the smaller value.

    ``truths`` has ``(group, field_name, value, record, support, n_values)`` with
    the best graded record that claims the value; a field that no member fills
    has no row. ``reliability`` has ``(source, field_name, reliability)``.
    Null groups and records are dropped; repeated claims count once; a null
    source counts as the source ``''``. Group sizes are unbounded: a group is
    only ever touched by partial aggregation.
    """
    spark = claims.sparkSession
    scratch = Scratch(spark, "truth")
    types = dict(claims.dtypes)
    grade = F.struct(*[t.alias(f"k{i}") for i, t in enumerate(trust or [])], F.col(record).cast("string").alias("id"))
    coarse = F.struct(*[t.alias(f"k{i}") for i, t in enumerate(trust)]) if trust else F.struct(F.lit(0).alias("k0"))
    filled = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(has_value(F.col(f), types[f]), F.col(f).cast("string")).alias("value")) for f in fields]),
        lambda x: x["value"].isNotNull(),
    )
    votes = scratch.save(
        claims.where(F.col(group).isNotNull() & F.col(record).isNotNull())
        .select(F.col(group).alias("g"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), grade.alias("grade"), coarse.alias("coarse"), F.explode(filled).alias("c"))
        .groupBy("g", "c.field_name", "c.value", "s").agg(F.min("grade").alias("grade"), F.min("coarse").alias("coarse"), F.count_distinct("grade").alias("n"))
    )
    weights = votes.select("s", "field_name").distinct().withColumn("w", F.lit(0.8))
    before, truths = None, None
    for turn in range(max_rounds):
        support = votes.join(weights, ["s", "field_name"]).groupBy("g", "field_name", "value").agg(
            F.min("coarse").alias("coarse"), F.min("grade").alias("grade"), F.sum(F.col("w") * F.col("n")).alias("support")
        )
        chosen = scratch.save(
            support.groupBy("g", "field_name").agg(
                F.min(F.struct("coarse", (-F.col("support")).alias("lack"), "grade", "value")).alias("best"), F.count("*").alias("n_values")
            ).select("g", "field_name", F.col("best.value").alias("value"), F.col("best.grade.id").alias("id"), (-F.col("best.lack")).alias("support"), "n_values")
        )
        fresh = scratch.save(
            votes.join(chosen.select("g", "field_name", F.col("value").alias("truth")), ["g", "field_name"])
            .groupBy("s", "field_name").agg(((F.sum(F.when(F.col("value") == F.col("truth"), F.col("n")).otherwise(0)) + 4.0) / (F.sum("n") + 5.0)).alias("w"))
        )
        if turn > max_rounds // 3:
            halfway = fresh.join(weights.withColumnRenamed("w", "old"), ["s", "field_name"]).select("s", "field_name", ((F.col("w") + F.col("old")) / 2).alias("w"))
            fresh, whole = scratch.save(halfway), fresh
            scratch.drop(whole)
        moved = fresh.join(weights.withColumnRenamed("w", "old"), ["s", "field_name"]).agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0] or 0.0
        scratch.drop(truths)
        scratch.drop(before)
        truths, before, weights = chosen, fresh, fresh
        if moved <= tolerance:
            break
    else:
        raise RuntimeError(f"reliabilities did not settle in {max_rounds} rounds")
    return (
        truths.select(F.col("g").alias(group), "field_name", "value", F.col("id").alias(record), "support", "n_values"),
        weights.select(F.col("s").alias(source), "field_name", F.col("w").alias("reliability")),
    )
