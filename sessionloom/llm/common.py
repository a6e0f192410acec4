"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Maps the bytes A-Z to a-z and leaves every other byte alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Spark's own switch: shuffle files go at the end of the query that made them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough that very long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode may a temporary one stand in; on a cluster it must be named.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: for results that are written or small, and are not computed again."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)


def stored(df: DataFrame, what: str = "table", over: list[str] | None = None, **options: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors.

    ``over`` gets the path, for dropped() once nothing reads the table any more.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    with shuffles_dropped(spark):
        df.write.parquet(path, **options)
    if over is not None:
        over.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(over: list[str]) -> None:
    """Delete stored tables that nothing reads any more; in a store that only Spark can reach they stay."""
    for path in over:
        with suppress(OSError, ValueError):
            fs, folder = pyarrow.fs.FileSystem.from_uri(path)
            fs.delete_dir(folder)
    over.clear()


def words(text: Column) -> Column:
    """Words of a text, in order; null and blank texts have none.  JVM-side, no lambda."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m
