"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import scratch_dir

#: What a row without an id is ordered by: before every real id.
NO_ID = -(1 << 63)


def text_tag():
    """A hash of the text, which with the id tells rows apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever it is stored."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once to the shared scratch folder and returns the written table, which has no lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    """How many partitions an exchange has, as the session says."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no training step may see: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, by: str, n: int) -> DataFrame:
    """The `n` rows with the least hash of column `by`, or all if there are fewer.

    A threshold on the hash comes first, so that the tasks together send about n rows to the driver, not n each.
    """
    total, hashed = df.count(), F.xxhash64(by)
    if total > n:
        df = df.where(hashed < int(1.3 * n / total * (1 << 64)) - (1 << 63) if 1.3 * n < total else F.lit(True))
    return df.orderBy(hashed, by).limit(n)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over batches, after which the worker gives its free memory back to the system.

    Spark keeps Python workers for later tasks, and an executor's memory bounds them together with its heap.
    """
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
