"""Nested API records as flat rows, and a paged source."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRACK = (
    "id string, name string, duration_ms bigint, popularity int, explicit boolean, external_ids struct<isrc:string>, artists array<struct<id:string,name:string>>, "
    "album struct<id:string,name:string,album_type:string,release_date:string,images:array<struct<url:string>>>"
)


def flatten_tracks(df: DataFrame, column: str) -> DataFrame:
    """Flat track rows from JSON texts: names joined in order, the first artist and image, absent parts null.

    Texts that are no track (broken JSON, no id) give no row.
    """
    t = df.select(F.from_json(column, TRACK).alias("t")).where("t.id is not null")
    first = F.try_element_at("t.artists", F.lit(1))
    return t.select(
        F.col("t.id").alias("spotify_track_id"), F.col("t.name").alias("track_name"), F.array_join(F.transform("t.artists", lambda a: a["name"]), ", ").alias("artist_names"),
        F.array_join(F.transform("t.artists", lambda a: a["id"]), ", ").alias("artist_ids"), first["name"].alias("primary_artist_name"), first["id"].alias("primary_artist_id"),
        F.coalesce(F.size("t.artists"), F.lit(0)).cast("long").alias("num_artists"), F.col("t.album.name").alias("album_name"), F.col("t.album.album_type").alias("album_type"),
        F.col("t.album.release_date").alias("album_release_date"), F.try_element_at("t.album.images", F.lit(1))["url"].alias("album_image_url"), "t.duration_ms", "t.popularity",
        F.coalesce("t.explicit", F.lit(False)).alias("explicit"), F.col("t.external_ids.isrc").alias("isrc"),
    )


class _Page(InputPartition):
    def __init__(self, path: str, offset: int):
        self.path, self.offset = path, offset


class _PageReader(DataSourceReader):
    def __init__(self, folder: str, start: int):
        self.folder, self.start = folder, start

    def partitions(self) -> list[_Page]:
        pages, at = [], 0
        for path in sorted(Path(self.folder).glob("*.json")):
            n = len(json.loads(path.read_text())["items"])
            if at + n > self.start:
                pages.append(_Page(str(path), at))
            at += n
        return pages

    def read(self, page: _Page) -> Iterator[tuple]:
        for i, item in enumerate(json.loads(Path(page.path).read_text())["items"], page.offset):
            track = (item or {}).get("track") or {}
            if i >= self.start and track.get("id") and not track.get("is_local"):
                yield i, track["id"], json.dumps(track)


class PagedPlaylist(DataSource):
    """Stored pages of a playlist as a table, one partition per page; ``start`` resumes at a position.

    Empty and local items give no row but keep their position.
    """

    @classmethod
    def name(cls) -> str:
        return "playlist_pages"

    def schema(self) -> str:
        return "position long, spotify_track_id string, track string"

    def reader(self, schema) -> _PageReader:
        return _PageReader(self.options["path"], int(self.options.get("start", 0)))
