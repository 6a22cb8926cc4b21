"""Perceptual ranks, statistics and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.durable import Scratch
from undertone.operators.aggregates import histogram_bin, unpivot
from undertone.operators.ranking import average_rank_shares, quantiles
from undertone.plans.base import FEATS_SQL, FEATURES, PERC_SQL, PERCEPTUAL, SIMILARITY, feats, perc
from undertone.plans.registry import query

_NEED = ["tempo_bpm", "rms_mean", "zcr_mean", "spectral_centroid_mean", "harmonic_ratio", "onset_strength_mean", "onset_strength_std", "beats_per_sec"]
# Signed terms of every axis, each a standard score but for the last three axes.
AXES = {
    "energy": [("rms", 1), ("onset", 1), ("rolloff", 1)],
    "danceability": [("band", 1), ("pulse", 1), ("beats", 1)],
    "acousticness": [("harmonic", 1), ("centroid", -1), ("flatness", -1), ("zcr", -1)],
    "speechiness": [("zcr", 1), ("flatness", 1), ("harmonic", -1)],
    "valence_proxy": [("mode", 1), ("tempo", 1), ("centroid", 1)],
}
PLAIN_AXES = {"brightness": "spectral_centroid_mean", "punch": "onset_strength_mean", "dynamics": "rms_std"}
_TERMS = {
    "rms": "rms_mean", "onset": "onset_strength_mean", "rolloff": "coalesce(spectral_rolloff_mean, spectral_centroid_mean)", "band": "exp(-power((tempo_bpm - 120) / 30, 2))",
    "pulse": "onset_strength_mean / (onset_strength_std + 1e-9)", "beats": "beats_per_sec", "harmonic": "harmonic_ratio", "centroid": "spectral_centroid_mean", "flatness": "coalesce(spectral_flatness_mean, 0.0)",
    "zcr": "zcr_mean", "mode": "case when lower(estimated_mode) like 'maj%' then 1.0 when lower(estimated_mode) like 'min%' then 0.0 else 0.5 end", "tempo": "tempo_bpm",
}
_AXES_SQL = f"""with {FEATS_SQL},
t as (select id, {", ".join(f"cast({e} as double) as {k}" for k, e in _TERMS.items())}, {", ".join(f"{c} as raw_{a}" for a, c in PLAIN_AXES.items())}
  from feats where {" and ".join(f"{c} is not null" for c in _NEED)}),
st as (select {", ".join(f"avg({k}) as m_{k}, stddev_samp({k}) as s_{k}" for k in _TERMS)} from t),
z as (select id, rms, {", ".join(f"raw_{a}" for a in PLAIN_AXES)}, {", ".join(f"case when s_{k} > 1e-12 then ({k} - m_{k}) / s_{k} else 0 end as z_{k}" for k in _TERMS)} from t, st),
q as (select id, round(20 * log10(greatest(rms, 1e-9)), 2) as loudness_db, {", ".join("round(" + " + ".join(f"{sign} * z_{k}" for k, sign in terms) + f", 9) as raw_{a}" for a, terms in AXES.items())}, {", ".join(f"raw_{a}" for a in PLAIN_AXES)} from z)"""


def _pct_sql(c: str) -> str:
    return f"case when {c} is not null then (rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2.0) / count({c}) over () end"


def _axes(spark: SparkSession, root: str) -> DataFrame:
    rows = feats(spark, root).dropna(subset=_NEED)
    t = rows.select("id", *[F.expr(e).cast("double").alias(k) for k, e in _TERMS.items()], *[F.col(c).alias(f"raw_{a}") for a, c in PLAIN_AXES.items()])
    t = Scratch(spark, "terms").save(t)
    stats = t.agg(*[F.avg(k).alias(f"m_{k}") for k in _TERMS], *[F.stddev_samp(k).alias(f"s_{k}") for k in _TERMS])
    z = {k: F.when(F.col(f"s_{k}") > 1e-12, (F.col(k) - F.col(f"m_{k}")) / F.col(f"s_{k}")).otherwise(0.0) for k in _TERMS}
    sums = [F.round(sum((sign * z[k] for k, sign in terms), F.lit(0.0)), 9).alias(f"raw_{a}") for a, terms in AXES.items()]
    loudness = F.round(20 * F.log10(F.greatest(F.col("rms"), F.lit(1e-9))), 2).alias("loudness_db")
    return t.join(F.broadcast(stats), F.lit(True)).select("id", loudness, *sums, *[f"raw_{a}" for a in PLAIN_AXES])


@query(f"{_AXES_SQL} select id, loudness_db, count(*) over () as population_n, " + ", ".join(f"round({_pct_sql(f'raw_{a}')}, 4) as {a}" for a in [*AXES, *PLAIN_AXES]) + " from q")
def perceptual_axes(spark: SparkSession, root: str) -> DataFrame:
    """The eight derived axes as average-tie percentile ranks of sums of standard scores, and the level in dBFS.

    Flatness counts 0 where an extraction has none; an axis without its column is null.
    """
    rows = Scratch(spark, "axes").save(_axes(spark, root))
    names = [*AXES, *PLAIN_AXES]
    shares = average_rank_shares(rows, "id", [f"raw_{a}" for a in names])
    n = rows.agg(F.count("*").alias("population_n"))
    return rows.select("id", "loudness_db").join(shares, "id").join(F.broadcast(n), F.lit(True)).select("id", "loudness_db", "population_n", *[F.round(f"raw_{a}", 4).alias(a) for a in names])


_STATS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    f"with {PERC_SQL}, l as (unpivot (select {', '.join(PERCEPTUAL)} from perc) on {', '.join(PERCEPTUAL)} into name feature value v) select feature, count(*) as n, round(avg(v) filter (where abs(v) < 1e12), 8) as mean, "
    "round(stddev_pop(v) filter (where abs(v) < 1e12), 8) as std, round(min(v), 8) as low, " + ", ".join(f"round(quantile_cont(v, {q}), 8) as p{int(q * 100)}" for q in _STATS) + ", round(max(v), 8) as high from l group by 1"
)
def feature_stats(spark: SparkSession, root: str) -> DataFrame:
    """Count, mean, spread, extremes and interpolated percentiles of every perceptual column.

    Values of 1e12 and more are no measurements of these columns; only mean and
    spread, which they would swamp, leave them out.
    """
    long = unpivot(perc(spark, root), [], PERCEPTUAL).where("value is not null")
    sane = F.when(F.abs("value") < 1e12, F.col("value"))
    rows = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg(sane).alias("mean"), F.stddev_pop(sane).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    rows = rows.join(quantiles(long, ["feature"], "value", _STATS), "feature")
    return rows.select("feature", "n", *[F.round(c, 8).alias(c) for c in ("mean", "std", "low")], *[F.round(F.col("p")[i], 8).alias(f"p{int(q * 100)}") for i, q in enumerate(_STATS)], F.round("high", 8).alias("high"))


RAW_SHARES = [0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95]


@query(
    f"with {FEATS_SQL}, l as (unpivot (select {', '.join(FEATURES)} from feats) on {', '.join(FEATURES)} into name feature value v) select feature, count(*) as n, round(avg(v), 8) as mean, round(stddev_pop(v), 8) as std, "
    + ", ".join(f"round(quantile_cont(v, {q}), 8) as p{round(q * 100)}" for q in RAW_SHARES) + " from l group by 1"
)
def raw_feature_stats(spark: SparkSession, root: str, rounded: bool = True) -> DataFrame:
    """Thirteen quantiles and population spread of every extracted feature."""
    long = unpivot(feats(spark, root), [], FEATURES).where("value is not null")
    rows = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).join(quantiles(long, ["feature"], "value", RAW_SHARES), "feature")
    flat = rows.select("feature", "n", "mean", "std", *[F.col("p")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(RAW_SHARES)])
    return flat.select("feature", "n", *[F.round(c, 8).alias(c) for c in flat.columns[2:]]) if rounded else flat


_DERIVED = ["energy", "danceability", "acousticness", "speechiness", "brightness", "punch", "dynamics", "valence_proxy"]


@query(
    f"""with {PERC_SQL}, l as (unpivot (select {', '.join(_DERIVED + ['tempo', 'loudness_db'])} from perc) on {', '.join(_DERIVED + ['tempo', 'loudness_db'])} into name feature value v),
  ok as (select * from l where abs(v) < 1e12), e as (select feature, min(v) as lo, max(v) as hi from ok group by 1),
  r as (select feature, case when feature in ('tempo', 'loudness_db') then case when hi > lo then lo else lo - 0.5 end else 0 end as lo, case when feature in ('tempo', 'loudness_db') then case when hi > lo then hi else hi + 0.5 end else 1 end as hi from e)
  select feature, cast(greatest(0, least(19, floor((v - lo) / (hi - lo) * 20))) as bigint) as bin, count(*) as n from ok join r using (feature)
  where v between lo and hi group by 1, 2"""
)
def feature_histograms(spark: SparkSession, root: str) -> DataFrame:
    """Twenty equal bins: over [0, 1] for derived axes, over the observed range for measured ones."""
    measured = F.col("feature").isin("tempo", "loudness_db")
    ok = unpivot(perc(spark, root), [], [*_DERIVED, "tempo", "loudness_db"]).where("abs(value) < 1e12")
    e = ok.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    flat = F.col("b") <= F.col("a")
    e = e.select("feature", F.when(measured, F.when(flat, F.col("a") - 0.5).otherwise(F.col("a"))).otherwise(0.0).alias("lo"), F.when(measured, F.when(flat, F.col("b") + 0.5).otherwise(F.col("b"))).otherwise(1.0).alias("hi"))
    rows = ok.join(F.broadcast(e), "feature").where("value between lo and hi")
    return rows.groupBy("feature", histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"with {FEATS_SQL} select "
    + ", ".join(f"round(avg(coalesce({c}, 0)), 8) as mean_{c}, round(case when stddev_pop(coalesce({c}, 0)) > 0 then stddev_pop(coalesce({c}, 0)) else 1 end, 8) as std_{c}" for c in SIMILARITY)
    + ", count(*) as n from feats"
)
def similarity_scale(spark: SparkSession, root: str) -> DataFrame:
    """Means and population spreads of the similarity columns, missing values as 0."""
    rows = feats(spark, root)
    parts = [F.count("*").alias("n")]
    for c in SIMILARITY:
        filled = F.coalesce(F.col(c), F.lit(0.0))
        parts += [F.round(F.avg(filled), 8).alias(f"mean_{c}"), F.round(F.when(F.stddev_pop(filled) > 0, F.stddev_pop(filled)).otherwise(1.0), 8).alias(f"std_{c}")]
    return rows.agg(*parts)


@query(f"with {FEATS_SQL} select " + ", ".join(f"round(count({c}) / count(*), 6) as {c}" for c in FEATURES) + " from feats")
def feature_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Share of tracks that have each column, which selects the columns of a model."""
    return feats(spark, root).agg(*[F.round(F.count(c) / F.count("*"), 6).alias(c) for c in FEATURES])


@query(f"with {FEATS_SQL} select id, tempo_bpm from feats where tempo_bpm <= 1")
def broken_extractions(spark: SparkSession, root: str) -> DataFrame:
    return feats(spark, root).where("tempo_bpm <= 1").select("id", "tempo_bpm")


@query(f"with {FEATS_SQL} select id from feats where " + " and ".join(f"{c} is not null" for c in SIMILARITY))
def complete_rows(spark: SparkSession, root: str) -> DataFrame:
    return feats(spark, root).dropna(subset=SIMILARITY).select("id")


@query(
    f"with {PERC_SQL} select version, count(*) as n, round(avg(tempo) filter (where abs(tempo) < 1e12), 8) as tempo, round(median(energy), 8) as energy_median, count(*) filter (where mode >= 0.5) as n_major from perc group by 1"
)
def version_totals(spark: SparkSession, root: str) -> DataFrame:
    """Tracks, mean tempo, median energy and major keys of every version; a bound on tempo holds for its average only."""
    tempo = F.when(F.abs("tempo") < 1e12, F.col("tempo"))
    rows = Scratch(spark, "versions").save(perc(spark, root).select("version", "tempo", "energy", "mode"))
    one = rows.groupBy("version").agg(F.count("*").alias("n"), F.round(F.avg(tempo), 8).alias("tempo"), F.count_if(F.col("mode") >= 0.5).alias("n_major"))
    middle = quantiles(rows, ["version"], "energy", [0.5]).select(F.col("version").alias("v"), F.round(F.col("p")[0], 8).alias("energy_median"))
    return one.join(middle, F.col("version").eqNullSafe(F.col("v")), "left").select("version", "n", "tempo", "energy_median", "n_major")
