"""Helpers that several training-data operators share: shared storage, two-level ranks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.storage import discard, materialise, release, shared_dir  # noqa: F401  operators take them from here

#: A word is a run of characters other than these six (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Number of hash buckets in which ranks and running sums are first taken.
BUCKETS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` in each group, in the order (bucket, *order).

    Taken in two levels, so that a group that holds a third of all rows is spread over as many
    tasks as it has buckets: sums of the buckets first (one row for each bucket), then within each
    bucket. ``df`` is read twice; materialise it before if it is costly. ``group`` columns must not
    be null.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum")).select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, [*group, bucket]).withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of so many bytes at most, or of one row, as texts may be long: bounds what a Python
    worker holds. Rows in a batch stay as the session has them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > size:
        spark.conf.set(key, str(size))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow; at a partition's end the worker, which Spark keeps for other tasks, gives
    freed memory back to the system."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return whole
