"""Stored derived tables: overwrite, read back, and the empty-input guard."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def overwrite(df: DataFrame, target: str) -> DataFrame:
    """Replace a table or folder by ``df`` and return the stored result.

    A target with a slash is a Parquet folder, anything else a catalog table.
    Reading back what was written means later summaries scan a small table
    instead of running the whole plan again, and a lost executor cannot force
    more than that scan to be repeated. A folder is written beside the target
    and takes its place when it is complete, so a failed job leaves the old
    table, and ``df`` may read the table it replaces.
    """
    spark = df.sparkSession
    if "/" in target:
        target = target.rstrip("/")
        fresh = f"{target}-{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        _replace(spark, fresh, target)
    else:
        df.write.mode("overwrite").format("parquet").saveAsTable(target)
    return read(spark, target)


class Files:
    """Folders of whatever file system the paths are on."""

    def __init__(self, spark: SparkSession):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _on(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._on(path).exists(self._path(path))

    def rename(self, old: str, new: str) -> bool:
        return self._on(old).rename(self._path(old), self._path(new))

    def delete(self, path: str) -> None:
        self._on(path).delete(self._path(path), True)

    def partitions(self, path: str, column: str) -> list[str]:
        """Values of a partition column, from the names of the folders right under ``path``."""
        if not self.exists(path):
            return []
        names = [s.getPath().getName() for s in self._on(path).listStatus(self._path(path)) if s.isDirectory()]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def _replace(spark: SparkSession, fresh: str, target: str) -> None:
    """Puts a complete folder where the old one was; the old one goes last."""
    files, old = Files(spark), f"{fresh}-old"
    had_one = files.exists(target)
    if had_one and not files.rename(target, old):
        raise OSError(f"{target} could not be set aside; the new rows are in {fresh}")
    if not files.rename(fresh, target):
        if had_one:
            files.rename(old, target)
        raise OSError(f"{target} could not be replaced; the new rows are in {fresh}")
    if had_one:
        files.delete(old)
    spark.catalog.refreshByPath(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if "/" in target else spark.table(target)


def has_rows(df: DataFrame, what: str) -> bool:
    """Guard before an expensive step; stops at the first row instead of counting."""
    if df.isEmpty():
        log.warning("%s is empty; nothing to do", what)
        return False
    return True
