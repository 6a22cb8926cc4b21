"""Arrays that describe a track over time, and the key of a chroma vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Krumhansl-Kessler key profiles.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def finite(curve: Column) -> Column:
    return F.filter(curve.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))


def resample_unit(curve: Column, points: int = 96) -> Column:
    """Curve scaled to [0, 1] on an even grid by linear interpolation; null when flat or under 8 values."""
    c = finite(curve)
    n, low, high = F.size(c), F.array_min(c), F.array_max(c)

    def at(g: Column) -> Column:
        x = g.cast("double") * (n - 1) / (points - 1)
        i = F.least(F.floor(x).cast("int"), n - 2)
        a, b = F.get(c, i), F.get(c, i + 1)
        return (a + (b - a) * (x - i) - low) / (high - low)

    return F.when((n >= 8) & (high > low), F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def nearest_rank(curve: Column, share: float) -> Column:
    """Value at ``int(share * (n - 1))`` of the sorted curve, not interpolated."""
    c = F.array_sort(finite(curve))
    return F.get(c, F.floor((F.size(c) - 1) * share).cast("int"))


# A fade ends within 8 dB of the sustained level, starts 20 dB below it and takes 4 % of the track.
FADE_REACH_DB, FADE_DEPTH_DB, FADE_SHARE = 8.0, 20.0, 0.04


def fade_bounds(curve: Column) -> Column:
    """``struct<intro, outro>``: where a fade from silence ends and a fade to silence starts, as shares of the track.

    The sustained level is the 80th percentile by nearest rank. A side is null
    without a fade there, both are for curves of fewer than 5 values.
    """
    c = finite(curve)
    n, full = F.size(c), nearest_rank(curve, 0.8)
    loud = F.transform(c, lambda x: x >= full - FADE_REACH_DB)
    last = n - 1
    intro = (F.array_position(loud, True) - 1) / last
    outro = (n - F.array_position(F.reverse(loud), True)) / last
    deep = full - FADE_DEPTH_DB
    start = F.when((F.get(c, F.lit(0)) <= deep) & (intro >= FADE_SHARE), intro)
    end = F.when((F.get(c, last) <= deep) & (1 - outro >= FADE_SHARE), outro)
    return F.when(n >= 5, F.struct(start.alias("intro"), end.alias("outro")))


def _profiles() -> Column:
    """The 24 rotated profiles, centred and scaled to length 1."""
    rows = []
    for k in range(12):
        for m, (p, mode) in enumerate(((MAJOR, "major"), (MINOR, "minor"))):
            turned = [x - sum(p) / 12 for x in (p[-k:] + p[:-k] if k else p)]
            size = sum(x * x for x in turned) ** 0.5
            rows.append(F.struct(F.lit([x / size for x in turned]).alias("p"), F.lit(-(2 * k + m)).alias("o"), F.lit(k).alias("key"), F.lit(mode).alias("mode")))
    return F.array(*rows)


def estimate_key(chroma: Column) -> Column:
    """``struct<key, mode>`` with the highest Pearson correlation; ties go to the lower key, then to major.

    Null unless there are 12 values that are not all equal.
    """
    v = chroma.cast("array<double>")

    def fit(row: Column) -> Column:
        r = F.aggregate(F.zip_with(v, row["p"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.struct(F.round(r, 9).alias("r"), row["o"].alias("o"), row["key"].alias("key"), row["mode"].alias("mode"))

    best = F.array_max(F.transform(_profiles(), fit))
    return F.when((F.size(v) == 12) & (F.array_min(v) < F.array_max(v)), F.struct(best["key"].alias("key"), best["mode"].alias("mode")))


def sections(text: Column, most: int = 60, shortest: float = 1.0) -> Column:
    """Sections of a JSON list with their place in it; lists that are too long give none, short sections go."""
    kind = "array<struct<start:double,end:double,label:int,tempo_bpm:double,loudness_db:double,key:int,mode:string>>"
    rows = F.coalesce(F.from_json(text, kind), F.array().cast(kind))
    placed = F.transform(rows, lambda s, i: F.struct(i.alias("section_index"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["tempo_bpm"].alias("tempo_bpm"), s["loudness_db"].alias("loudness_db"), s["key"].alias("key"), s["mode"].alias("mode")))
    return F.filter(F.when(F.size(rows) <= most, placed), lambda s: s["end"] - s["start"] >= shortest)
