"""Cutting lineage with tables in a folder that all executors share.

Iterative operators write each round to parquet under the checkpoint folder
of the session, so that a lost executor never takes intermediate rows with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='undertone-')}"
    spark.sparkContext.setCheckpointDir(root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_OPEN: list[Scratch] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def sweep() -> None:
    """Remove the intermediate tables of all queries so far; none of their results may be read any more."""
    while _OPEN:
        _OPEN.pop().close()


class Scratch:
    """Named folder of written intermediate tables, removed by ``sweep`` or when the process ends.

    With ``free``, the shuffle files that a table took are removed once it is written.
    """

    def __init__(self, spark: SparkSession, label: str, free: bool = False):
        self.spark = spark
        self.free = free
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        _OPEN.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = f"{self.root}/{uuid.uuid4().hex[:10]}"
        before = self.spark.conf.get(_FREE, None)
        if self.free:
            self.spark.conf.set(_FREE, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.free and before is None:
                self.spark.conf.unset(_FREE)
            elif self.free:
                self.spark.conf.set(_FREE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that ``save`` returned and that nothing reads any more."""
        path = self._paths.pop(id(df), None) if df is not None else None
        if path:
            _delete(self.spark, path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass


atexit.register(sweep)
