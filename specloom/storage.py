"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a job's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a side of a join may have to be broadcast: as files suggest, and as measured in its shuffle.
_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, only where that is
    unset in local mode (tests), a temporary folder of this machine. On a cluster executors would
    write to their own disks, so there it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='specloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    return at


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again. The lineage is cut there, so
    a lost executor costs a re-read of the files and no recomputation. The shuffle files behind it
    are not needed any more and go at once. Rows are in a folder for each value of ``by``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/specloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    if before:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        if before:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is written inside broadcasts a side of a join only by the size that its shuffle had. Texts that
    repeat themselves are many times larger as rows than in their files, and what is broadcast goes through the
    driver."""
    before = {k: spark.conf.get(k, None) for k in (_GUESSED, _MEASURED)}
    spark.conf.set(_MEASURED, before[_MEASURED] or spark.conf.get(_GUESSED))
    spark.conf.set(_GUESSED, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` with measured broadcasts."""
    with measured_broadcasts(df.sparkSession):
        return materialise(df, name)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialise`` gave, once nothing will read them again."""
    _delete(df.sparkSession, df._written_to)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete what ``materialise`` wrote for this application, once its results are no longer read."""
    _delete(spark, f"{shared_dir(spark)}/specloom/{spark.sparkContext.applicationId}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
