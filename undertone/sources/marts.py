"""Written marts: atomic replacement, schema contracts, the star schema, insights and snapshots of tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old or the new text, never a part."""
    draft, fs = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    final, _ = _fs(spark, path)
    fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"cannot replace {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    reader = fs.open(where)
    size = fs.getFileStatus(where).getLen()
    data = bytes(spark._jvm.org.apache.commons.io.IOUtils.readFully(reader, int(size)))
    reader.close()
    return data.decode("utf-8")


def replace(df: DataFrame, folder: str, keep: int = 2) -> str:
    """Write a new version of a table beside the old one, then point to it; the newest ``keep`` versions stay.

    Readers that started on the old version can finish on it.
    """
    spark = df.sparkSession
    old = versions(spark, folder)
    name = f"v{int(old[-1][1:]) + 1 if old else 1:08}"
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    write_text(spark, f"{folder}/{POINTER}", name)
    for stale in [*old, name][:-keep]:
        where, fs = _fs(spark, f"{folder}/{stale}")
        fs.delete(where, True)
    return name


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the written versions, oldest first."""
    where, fs = _fs(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("v"))


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the pointer names."""
    name = read_text(spark, f"{folder}/{POINTER}")
    if name is None:
        raise FileNotFoundError(f"{folder} holds no table")
    return spark.read.parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, name: str) -> None:
    """Point back to an older version that can be read."""
    spark.read.parquet(f"{folder}/{name}").schema  # noqa: B018 - fails before the pointer moves
    write_text(spark, f"{folder}/{POINTER}", name)


def present_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def require_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The frame itself if it has the columns with their types, else an error that names all faults."""
    have = dict(df.dtypes)
    faults = [f"{c}: missing" if c not in have else f"{c}: {have[c]} for {t}" for c, t in wanted.items() if have.get(c) != t]
    if faults:
        raise ValueError("; ".join(faults))
    return df


def join_suffixed(left: DataFrame, right: DataFrame, key: str, suffix: str = "_f") -> DataFrame:
    """Left join; columns of the right that clash get the suffix."""
    clash = set(left.columns) & set(right.columns) - {key}
    return left.join(right.select(key, *[F.col(c).alias(c + suffix if c in clash else c) for c in right.columns if c != key]), key, "left")


def save_top_items(frames: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One file set per kind of item (``top_tracks``, ``top_artists``); empty frames write nothing."""
    paths = {}
    for kind, df in frames.items():
        if not df.isEmpty():
            paths[kind] = f"{folder}/top_{kind}.parquet"
            df.write.mode("overwrite").parquet(paths[kind])
    return paths


def star_schema(spark: SparkSession, root: str, folder: str) -> dict[str, str]:
    """Fact and dimensions as written tables; the marts read them instead of parsing JSON again."""
    from undertone.plans.base import feats, perc, ranked_listen, windows
    from undertone.plans.joins import artists

    from undertone.tables import table

    parts: dict[str, Callable[[], DataFrame]] = {
        "dim_window": lambda: windows(spark), "dim_artist": lambda: artists(spark, root), "dim_track": lambda: table(spark, root, "track_meta").where("spotify_track_id is not null").withColumnRenamed("spotify_track_id", "id"),
        "features": lambda: feats(spark, root), "perceptual": lambda: perc(spark, root), "fact_listening": lambda: ranked_listen(spark, root),
    }
    return {name: replace(make(), f"{folder}/{name}") for name, make in parts.items()}


def insights(sections: dict[str, DataFrame], path: str, most: int = 200) -> dict:
    """Small report frames as one JSON file and one Markdown file with the same content."""
    spark = next(iter(sections.values())).sparkSession
    body: dict = {"schema_version": 1}
    lines = []
    for name, df in sections.items():
        rows = [json.loads(r) for r in df.orderBy(*df.columns).limit(most).toJSON().collect()]
        body[name] = rows
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(str(r.get(c, "")).replace("|", "\\|") for c in df.columns) + " |" for r in rows] + [""]
    write_text(spark, f"{path}.json", json.dumps(body, ensure_ascii=False, indent=1, sort_keys=True))
    write_text(spark, f"{path}.md", "\n".join(lines))
    return body
