"""Session plumbing that operators share: shipping the package, the shared scratch folder, written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a table that is broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 100_000

_shipped: dict[str, str] = {}
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="parlance-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "parlance.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for base, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    archive.write(path, os.path.join("parlance", os.path.relpath(path, top)))
    context.addPyFile(target)
    _shipped[context.applicationId] = target


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local (tests).

    On a cluster a folder of the driver's machine would lose tables, so there it must be set.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="parlance-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found.rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables that materialize() has written in this application; what was read from them must be done with by then."""
    configuration = spark._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(configuration).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts lineage (a lost executor costs no recomputation of what is above) and keeps the
    columns prunable for the readers. clean_up() deletes all such tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted), else df for a shuffled join.

    df should be a materialized table, so that the count reads only metadata.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; parquet carries the schema, so nothing is inferred from rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """df as one struct column _row, so that helper columns beside it cannot clash with its own; select("_row.*") undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
