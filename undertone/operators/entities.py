"""Duplicate resolution: title keys, pair rules, components, canonical members."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from undertone.durable import Scratch
from undertone.functions.text import squeeze
from undertone.functions.vectors import cosine

# What marks a part of a title as credit, release or version.
CREDIT_WORDS = r"^(feat|ft|featuring|with)\b"
RELEASE_WORDS = r"\b(remaster(ed)?|reissue|anniversary|deluxe|edition|bonus|mono|stereo|explicit|clean|single version|album version)\b"
VERSION_WORDS = r"\b(live|acoustic|unplugged|demo|remix|mix|dub|edit|instrumental|karaoke|reprise|slowed|sped up|session|version|cover)\b"
SAME_WINDOW_MS, BLIND_WINDOW_MS = 7000, 1500

_credit, _release, _version = re.compile(CREDIT_WORDS), re.compile(RELEASE_WORDS), re.compile(VERSION_WORDS)
_part = re.compile(r"[(\[]([^()\[\]]*)[)\]]")


def _plain(text: str) -> str:
    kept = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return kept.replace("'", "").replace("’", "")


def _squash(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text))


def title_key(title: str | None) -> tuple[str, str]:
    """``(base, version)``: folded title without credits and releases, and its version tags."""
    if not title:
        return "", ""
    tags: set[str] = set()

    def known(part: str) -> bool:
        words = _squash(part)
        if _credit.search(words) or _release.search(words):
            return True
        if _version.search(words):
            tags.add(words)
            return True
        return False

    text = _part.sub(lambda m: " " if known(m.group(1)) else f" {m.group(1)} ", _plain(title))
    while (at := text.rfind(" - ")) > 0 and known(text[at + 3 :]):
        text = text[:at]
    base = _squash(re.sub(r"\s(feat|ft|featuring)\b\.?\s.*$", "", text))
    return base, " + ".join(sorted(tags))


@F.pandas_udf(StructType([StructField("base", StringType()), StructField("version", StringType())]))
def title_keys(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([title_key(t) for t in titles], columns=["base", "version"])


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def leading_artist(col: Column) -> Column:
    """First name of a packed artist field, folded."""
    return squeeze(F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*((?:(?!\s(?:feat|ft|featuring|x)\b)[^,;/&|(])*)", 1))


def artists_agree(id_a: Column, id_b: Column, name_a: Column, name_b: Column) -> Column:
    """Equal ids where both are known, else equal and non-empty leading names."""
    lead = leading_artist(name_a)
    return F.when(id_a.isNotNull() & id_b.isNotNull(), id_a == id_b).otherwise((lead != "") & (lead == leading_artist(name_b)))


def durations_agree(a: Column, b: Column, same_credit: Column) -> Column:
    """Within 7 s for one credit, unknown passing; within 1.5 s and both known otherwise."""
    gap = F.abs(a - b)
    return F.when(same_credit, F.coalesce(gap <= SAME_WINDOW_MS, F.lit(True))).otherwise(F.coalesce(gap <= BLIND_WINDOW_MS, F.lit(False)))


def sounds_agree(a: Column, b: Column, least: float = 0.95) -> Column:
    """Cosine of at least ``least``; a missing vector passes."""
    return F.when(a.isNull() | b.isNull(), True).otherwise(cosine(a, b) >= least)


def numbering(col: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"(\d+)"), F.lit(1))


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)``, the component named by its smallest vertex.

    Each round takes the smallest label around a vertex, hands it to the vertex's
    old label as well, and follows it one step further, so the rounds grow with
    the logarithm of a path; rows stay one per vertex plus the edges.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "labels")
    e = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    edges = scratch.save(e.union(e.select("y", "x")).distinct())
    labels = scratch.save(edges.groupBy(F.col("x").alias("v")).agg(F.min(F.least("x", "y")).alias("c")))
    for _ in range(max_rounds):
        around = edges.join(labels.select(F.col("v").alias("y"), "c"), "y").groupBy(F.col("x").alias("v")).agg(F.min("c").alias("n"))
        near = labels.join(around, "v", "left").select("v", "c", F.least("c", F.coalesce("n", "c")).alias("n"))
        hooked = near.select(F.inline(F.array(F.struct("v", "n", F.col("c").cast("string").alias("c")), F.struct(F.col("c").alias("v"), "n", F.lit(None).cast("string").alias("c")))))
        near = hooked.groupBy("v").agg(F.min("n").alias("n"), F.max("c").alias("c")).where("c is not null")
        jump = labels.select(F.col("v").alias("n"), F.col("c").alias("j"))
        seen = Observation()
        least = F.least("n", F.coalesce("j", "n"))
        fresh = near.join(jump, "n", "left").select("v", least.alias("c"), (least != F.col("c")).alias("moved"))
        fresh = scratch.save(fresh.observe(seen, F.count_if("moved").alias("n")))
        scratch.drop(labels)
        labels = fresh
        if not seen.get["n"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select(F.col("v").alias("vertex"), F.col("c").alias("component"))


def canonical_member(df: DataFrame, group: str, ident: str, cached: str, duration: str) -> DataFrame:
    """Best member of every group: cached first, then longer (unknown or 0 last), then the smaller id."""
    key = F.struct((~F.coalesce(F.col(cached), F.lit(False))).alias("u"), (-F.coalesce(F.nullif(F.col(duration), F.lit(0)), F.lit(-1))).alias("d"), F.col(ident).alias("i"))
    return df.groupBy(group).agg(F.min(key)["i"].alias("canonical_id"), F.count("*").alias("n_members"))
