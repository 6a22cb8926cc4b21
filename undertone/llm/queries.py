"""Queries of the training-data operators, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.durable import Scratch
from undertone.llm.clusters import group_similar
from undertone.llm.components import hash_to_min
from undertone.llm.fusion import best_graded, discover_truth
from undertone.llm.leaks import MATCH, find_leaks
from undertone.llm.mixing import mix_sources
from undertone.llm.neighbours import nearest_vectors
from undertone.llm.quantiles import merge, percentiles, summarise
from undertone.llm.recordings import same_recordings
from undertone.llm.spans import shared_cover, shared_spans
from undertone.tables import table

FIELDS = ["isrc", "album_release_date", "popularity", "album_image_url", "duration_ms"]


def _members(spark: SparkSession, root: str) -> DataFrame:
    """Members of the reported groups with what ranks them and the fields they offer."""
    groups = table(spark, root, "duplicate_clusters").select("cluster_key", F.explode("members").alias("track_id")).where(F.col("track_id").isNotNull()).distinct()
    cached = table(spark, root, "dedup_records").groupBy("track_id").agg(F.coalesce(F.max("is_cached"), F.lit(False)).alias("is_cached"))
    meta = table(spark, root, "track_meta").select(F.col("spotify_track_id").alias("track_id"), *FIELDS)
    return (
        groups.join(cached, "track_id", "left").join(meta, "track_id", "left")
        .withColumn("is_cached", F.coalesce("is_cached", F.lit(False)))
        .withColumn("record", F.col("track_id"))
    )


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Surviving record and source of each field per reported group.

    Grades: cached first, then the longer duration with unknown last, then the
    smaller id. They are a total order, so no votes are taken here; ``p1_voted``
    is where they decide.
    """
    grade = [F.when(F.col("is_cached"), 0).otherwise(1), F.col("duration_ms").isNull(), -F.col("duration_ms").cast("decimal(20,0)"), F.col("track_id")]
    return best_graded(_members(spark, root), "cluster_key", "track_id", ["record", *FIELDS], grade)


def p1_voted(spark: SparkSession, root: str) -> DataFrame:
    """Fields chosen by the iterated votes alone, with their support.

    A source is where the track's newest extraction came from, and whether the record is cached.
    """
    taken = table(spark, root, "track_features").where(F.col("spotify_track_id").isNotNull()).groupBy(F.col("spotify_track_id").alias("track_id"))
    origin = taken.agg(F.max_by("extraction_source", F.struct("extracted_at", "extraction_source")).alias("origin"))
    source = F.concat_ws("/", F.coalesce("origin", F.lit("not extracted")), F.when(F.col("is_cached"), "cached").otherwise("listed"))
    claims = _members(spark, root).join(origin, "track_id", "left").withColumn("source", source)
    truths, _ = discover_truth(claims, "cluster_key", "track_id", "source", FIELDS)
    return truths.select("cluster_key", "field_name", "value", F.round("support", 6).alias("support"), "n_values")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of track ids that are the same recording."""
    pairs, members = same_recordings(table(spark, root, "track_meta"), "spotify_track_id", "track_name", "artist_names", "duration_ms")
    crowded = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    x = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    y = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    both = pairs.unionByName(crowded).join(x, "a").join(y, "b").where("x <> y and (a <> b or x < y)")
    return both.select(F.least("x", "y").alias("track_id_a"), F.greatest("x", "y").alias("track_id_b"))


ACOUSTIC = ["tempo_bpm", "rms_mean", "zcr_mean", "spectral_centroid_mean", "spectral_rolloff_mean", "spectral_bandwidth_mean", "harmonic_ratio", "onset_strength_mean", *[f"mfcc_mean_{i}" for i in range(5)]]
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(col: Column) -> Column:
    """A JSON value that is a number, quoted or not, as a double; anything else is null."""
    text = F.trim(col)
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) <= 1.7976931348623157e308, value)


def _json_numbers(rows: DataFrame, col: str, names: list[str], *keep: str) -> DataFrame:
    """The named numbers of a JSON object as doubles, from one parse of it, beside the columns ``keep``."""
    texts = rows.select(*keep, F.json_tuple(col, *names).alias(*[f"_{c}" for c in names]))
    return texts.select(*keep, *[_number(F.col(f"_{c}")).alias(c) for c in names])


def _acoustic(spark: SparkSession, root: str) -> DataFrame:
    """Tracks whose latest features row is complete, with the 13 values scaled to mean 0 and population spread 1."""
    rows = table(spark, root, "track_features").where(F.col("spotify_track_id").isNotNull())
    latest = rows.groupBy(F.col("spotify_track_id").alias("id")).agg(F.max_by("features", F.struct("extracted_at", "features")).alias("features"))
    parsed = _json_numbers(latest, "features", ACOUSTIC, "id")
    whole = Scratch(spark, "acoustic").save(parsed.dropna().where("tempo_bpm > 0"))
    spread = whole.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(ACOUSTIC)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(ACOUSTIC)]).first()
    scaled = [(F.col(c) - F.lit(spread[f"m{i}"])) / F.lit(spread[f"s{i}"] or 1.0) for i, c in enumerate(ACOUSTIC)]
    return whole.select("id", F.array(*scaled).alias("v"))


def _groups(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Members of the groups that sound alike, and the cluster that each group is under the newest model."""
    labels = table(spark, root, "track_clusters").where("cluster_id is not null and model_id is not null and spotify_track_id is not null")
    newest = labels.agg(F.max("model_id")).first()[0]
    labels = labels.where(F.col("model_id") == F.lit(newest)).select(F.col("spotify_track_id").alias("id"), F.col("cluster_id").cast("long").alias("cluster_id")).distinct()
    members, _ = group_similar(_acoustic(spark, root), "id", "v", labels.select("cluster_id").distinct().count())
    votes = members.join(labels, "id").groupBy("group", "cluster_id").agg(F.count("*").alias("n"))
    names = votes.groupBy("group").agg(F.min(F.struct((-F.col("n")).alias("lack"), "cluster_id"))["cluster_id"].alias("cluster_id"))
    return members, names


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Group of every complete track, under the cluster most of its tracks have in the newest model."""
    members, names = _groups(spark, root)
    return members.join(names, "group").select(F.col("id").alias("spotify_track_id"), "cluster_id")


def p3_typical(spark: SparkSession, root: str) -> DataFrame:
    """Size of every group and its ten tracks nearest to the group's mean."""
    members, names = _groups(spark, root)
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    rank = Window.partitionBy("group").orderBy("distance", "id")
    top = members.withColumn("typical_rank", F.row_number().over(rank)).where("typical_rank <= 10")
    return top.join(sizes, "group").join(names, "group").select("cluster_id", "size", "typical_rank", F.col("id").alias("spotify_track_id"), F.round("distance", 4).alias("distance"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The five tracks that sound most like each complete track."""
    near = nearest_vectors(_acoustic(spark, root), "id", "v", 5)
    return near.select(F.col("id").alias("spotify_track_id"), F.col("neighbour").alias("neighbour_id"))


PERCEPTUAL = ["tempo", "key", "mode", "duration_sec", "loudness_db", "time_signature", "energy", "danceability", "acousticness", "speechiness", "brightness", "punch", "dynamics", "valence_proxy"]
SHARES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _perceptual(spark: SparkSession, root: str) -> DataFrame:
    """The 14 numbers as doubles; a quoted number is a number, anything else is null."""
    return _json_numbers(table(spark, root, "track_perceptual"), "features", PERCEPTUAL, "version", "computed_at")


def p4_daily(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles by version and number from digests of single days (rank error 1 %), combined by node addition."""
    tag = F.when(F.col("version").isNull(), "0").otherwise(F.concat(F.lit("1"), "version"))
    rows = _perceptual(spark, root).withColumn("day", F.concat(F.coalesce(F.date_format("computed_at", "yyyy-MM-dd"), F.lit("?")), F.lit("|"), tag))
    days = merge(summarise(rows, "day", PERCEPTUAL, 0.01), 0.01, rows.rdd.getNumPartitions())
    tag = F.element_at(F.split("key", r"\|", 2), -1)
    whole = merge(days.withColumn("key", F.when(tag != "0", F.substring(tag, 2, 1 << 30))), 0.01)
    out = percentiles(whole, SHARES)
    return out.select(F.col("key").alias("version"), F.col("field").alias("feature"), "n", "share", "value", F.ceil(F.col("n") * 0.01).alias("rank_error"))


def p4_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """The same from one pass over all days; rank error at most 0.5 % of n."""
    rows = _perceptual(spark, root)
    digests = merge(summarise(rows, "version", PERCEPTUAL), parts=rows.rdd.getNumPartitions())
    out = percentiles(digests, SHARES)
    return out.select(F.col("key").alias("version"), F.col("field").alias("feature"), "n", "share", "value", F.ceil(F.col("n") * 0.005).alias("rank_error"))


def p4_verified(spark: SparkSession, root: str) -> DataFrame:
    """Whether every value of ``p4_percentiles`` lies within its stated rank error, by counting all values."""
    points = p4_percentiles(spark, root).groupBy("version", "feature").agg(F.sort_array(F.collect_list(F.struct("share", "value", "n", "rank_error"))).alias("points"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in PERCEPTUAL])
    values = _perceptual(spark, root).select(F.col("version").alias("v"), F.inline(pairs)).where("x is not null")
    both = values.join(points.withColumnRenamed("feature", "f"), (F.col("feature") == F.col("f")) & F.col("v").eqNullSafe(F.col("version")))
    counts = []
    for i in range(len(SHARES)):
        at = F.col("points")[i]["value"]
        slack = F.abs(at) * 2e-6
        counts.append(F.struct(F.count_if(F.col("x") < at - slack).alias("below"), F.count_if(F.col("x") <= at + slack).alias("upto")))
    seen = both.groupBy("version", "feature").agg(F.first("points").alias("points"), F.array(*counts).alias("counts"))
    rows = seen.select("version", "feature", F.inline(F.arrays_zip("points", "counts"))).select("version", "feature", "points.*", "counts.*")
    wanted = F.col("share") * F.col("n")
    within = (F.col("below") <= wanted + F.col("rank_error")) & (F.col("upto") >= wanted - F.col("rank_error"))
    return rows.select("version", "feature", "share", "n", within.alias("within"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Group of every record linked by accepted matches; the smallest id names the group."""
    links = table(spark, root, "match_pairs").where("accepted and track_id_a <> track_id_b").select("track_id_a", "track_id_b")
    return hash_to_min(links, "track_id_a", "track_id_b").select(F.col("vertex").alias("track_id"), F.col("component").alias("group_id"))


def _leaks(spark: SparkSession, root: str, **kw) -> DataFrame:
    return find_leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text", **kw)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with at least 8 consecutive words of an evaluation item.

    Eight equal words in a row score 8 matches or more, so the alignment score
    selects the rows; the exact check for a gapless run follows.
    """
    aligned = _leaks(spark, root, must=8).where(F.col("score") >= 8 * MATCH)
    return aligned.where("longest_run >= 8").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    """Leaks with their alignment, paraphrased and edited copies included (0.6 of the best score or more, or 8 words in a row).

    Seeds of 3 words, one in every 5, reach copies whose edits leave no longer run.
    """
    found = _leaks(spark, root, seed=3, must=5).where("longest_run >= 8 or share >= 0.6")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score", F.round("share", 4).alias("share"), "first_word", "last_word", "longest_run", "item_words")


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, list]:
    targets = [tuple(r) for r in table(spark, root, "mix_targets").select("source", "target_share", "max_repeats").collect()]
    return mix_sources(table(spark, root, "documents"), "doc_id", "source", "text", targets, block=128, shard_blocks=128), targets


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mixed blocks, one row per use of a stretch of a document."""
    return _mix(spark, root)[0].withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Shares really reached, with the repeats of the most used stretch."""
    rows, targets = _mix(spark, root)
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    got = rows.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"), F.count_distinct("shard", "slot").alias("blocks"), (F.max("pass") + 1).alias("repeats"))
    whole = got.agg(F.sum("tokens").alias("all_tokens"))
    return (
        wanted.join(got, "source", "left").join(F.broadcast(whole), F.lit(True), "left")
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 5).alias("share"))
    )


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of documents that share at least 300 verbatim characters."""
    links, copies = shared_spans(table(spark, root, "documents"), "doc_id", "text")
    member = copies.select(F.col("id").alias("doc"), "rep")
    texts = links.select("a", "b").unionByName(copies.where("id = rep and n > 1").select(F.col("id").alias("a"), F.col("id").alias("b")))
    both = texts.join(member.select(F.col("doc").alias("x"), F.col("rep").alias("a")), "a").join(member.select(F.col("doc").alias("y"), F.col("rep").alias("b")), "b")
    return both.where("x <> y and (a <> b or x < y)").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def p10_shared(spark: SparkSession, root: str) -> DataFrame:
    """Per document: its class of exact copies, its class of shared passages, and how much of it stands elsewhere."""
    docs = table(spark, root, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), "n_chars")
    rows = shared_cover(docs, "doc_id", "text").join(sizes, "id")
    return rows.select(F.col("id").alias("doc_id"), F.col("rep").alias("text_class"), F.col("passages").alias("passage_class"), "n_copies", "most_sharers", "shared_chars", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}
