"""Tables kept in folders: replaced as a whole, read again when they change, copied before they are changed, computed once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.runtime import shared_dir


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df beside path and moves it there, so that readers see the old table or the new one; df may read the old one."""
    spark = df.sparkSession
    new, fs = _path(spark, f"{path}.new")
    old, _ = _path(spark, f"{path}.old")
    here, _ = _path(spark, path)
    fs.delete(new, True)
    df.write.parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


class Watched:
    """A table that is read again when another program has replaced it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seen = spark, path, -1
        self.table: DataFrame | None = None

    def read(self) -> tuple[DataFrame, bool]:
        """The table as it is now, and whether it changed since the last read."""
        here, fs = _path(self.spark, self.path)
        modified = fs.getFileStatus(here).getModificationTime()
        changed = modified != self.seen
        if changed or self.table is None:
            self.seen, self.table = modified, self.spark.read.parquet(self.path)
        return self.table, changed


def backup(spark: SparkSession, path: str, stamp: str) -> str:
    """Copies a folder or file beside itself under its name and the stamp, and gives the copy's path."""
    here, fs = _path(spark, path)
    copy, _ = _path(spark, f"{path}.{stamp}.bak")
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, here, fs, copy, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{path} could not be copied")
    return f"{path}.{stamp}.bak"


def cached(spark: SparkSession, parts: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, computed once for the parts that it depends on (contents and settings as texts) and kept in the shared folder.

    Two that build the same at once both write; the first to finish is kept.
    """
    key = hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
    path = f"{shared_dir(spark)}/parlance/cache/{key}"
    done, fs = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        own = f"{path}.{hashlib.sha256(str(id(build)).encode()).hexdigest()[:8]}"
        build().write.mode("overwrite").parquet(own)
        mine, _ = _path(spark, own)
        here, _ = _path(spark, path)
        if fs.exists(here) or not fs.rename(mine, here):
            fs.delete(mine, True)
    return spark.read.parquet(path)
