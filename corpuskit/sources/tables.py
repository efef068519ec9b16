"""Reading the catalog tables, and writes that may be run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CATALOG

Reduce = Callable[[DataFrame], DataFrame]


def read_catalog(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A catalog table by its fixed schema, without inference."""
    return spark.read.schema(CATALOG[table]).parquet(f"{path}/{table}")


def _exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing is there or no file has been committed. Any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def scrub_nul(df: DataFrame) -> DataFrame:
    """Remove NUL characters from every string column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.translate(F.col(n), "\0", "") for n in names})


def copy_table(src: DataFrame, cols: list[str], path: str) -> DataFrame:
    """Copy some columns once; refuses a target that holds rows. Returns (rows_copied)."""
    spark = src.sparkSession
    target = _exists(spark, path)
    if target is not None and not target.isEmpty():
        raise ValueError(f"{path} already holds rows")
    scrub_nul(src.select(*cols)).write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_copied"))


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def append_changes(updates: DataFrame, path: str, batch: int) -> None:
    """Write a batch of changes beside the earlier ones, under its number.

    The cost follows the batch, not the table. The same batch written again replaces itself, a batch that failed
    half-way is replaced when it comes again, and no row written before is touched.
    """
    updates.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions; a version counts once its job has left the success mark."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    folders = [status.getPath() for status in fs.listStatus(root)]
    done = [f for f in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().removeprefix("upto=")) for f in done)


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The newest version, and the changes that came after it with their batch."""
    version, changes = None, _exists(spark, f"{path}/changes")
    if done := _versions(spark, path):
        version = spark.read.parquet(f"{path}/versions/upto={done[-1]}")
        changes = None if changes is None else changes.filter(F.col("batch") > done[-1])
    return version, changes


def read_state(spark: SparkSession, path: str, reduce: Reduce) -> DataFrame:
    """The current table: ``reduce`` over the newest version and all later changes.

    ``reduce`` keeps what counts of many rows per key (the last one, say), whatever their order, and gives the same
    for rows that it has reduced before.
    """
    version, changes = _rows(spark, path)
    changes = None if changes is None else changes.drop("batch")
    if version is None and changes is None:
        raise ValueError(f"{path} holds no table")
    if version is None:
        return reduce(changes)
    return reduce(version if changes is None else version.unionByName(changes))


def compact(spark: SparkSession, path: str, reduce: Reduce) -> None:
    """Fold the changes so far into a new version. Readers take it once it is complete; until then, and if the job
    dies, the old version and the changes are what they were."""
    _, changes = _rows(spark, path)
    last = None if changes is None else changes.agg(F.max("batch")).head()[0]
    if last is not None:
        read_state(spark, path, reduce).write.mode("overwrite").parquet(f"{path}/versions/upto={last}")


def drop_superseded(spark: SparkSession, path: str) -> None:
    """Delete versions and changes that the newest version has replaced. For times without readers of these."""
    done = _versions(spark, path)
    if not done:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(hadoop(f"{path}/versions")):
        if int(status.getPath().getName().removeprefix("upto=")) < done[-1]:
            fs.delete(status.getPath(), True)
    for status in fs.listStatus(hadoop(f"{path}/changes")):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) <= done[-1]:
            fs.delete(status.getPath(), True)


def current_segments(rows: DataFrame) -> DataFrame:
    """The segments of each book's newest generation, each as it was delivered last.

    ``rows``: book_id, seg_order, generation, delivered_at and other columns. A rebuild of a book carries a higher
    generation and so replaces the whole book; within a generation deliveries add up. What is current is found without
    the other columns: the generation is looked up by book after partial maxima, a hot book is split by the join. Texts
    are then moved and sorted once, for the join by which they are also reduced. They go to as many partitions as an
    exchange has: adaptive sizes are those of compressed texts, and sorts of coalesced partitions would spill.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct("seg_order", "delivered_at").alias("_at")  # as one key, nulls are equal
    values = [c for c in rows.columns if c not in ("book_id", "seg_order", "generation", "delivered_at")]
    last = rows.groupBy("book_id", "seg_order", "generation").agg(F.max("delivered_at").alias("delivered_at"))
    newest = rows.groupBy("book_id").agg(F.max("generation").alias("generation"))
    current = last.join(newest, ["book_id", "generation"]).select("book_id", "generation", at)
    keys = ["book_id", "generation", "_at"]
    values = rows.select("book_id", "generation", at, F.struct(*values).alias("s")).repartition(parts, *keys)
    kept = values.join(current, keys)
    return kept.groupBy(*keys).agg(F.max("s").alias("s")).select("book_id", "generation", "_at.*", "s.*").select(*rows.columns)


def write_segments(rows: DataFrame, path: str, batch: int) -> None:
    """Deliver segments (see ``current_segments``); ``read_segments`` gives what is current."""
    append_changes(rows, path, batch)


def read_delivery(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The rows of one batch as they were delivered, for as long as no version has superseded it."""
    return spark.read.parquet(f"{path}/changes/batch={batch}")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return read_state(spark, path, current_segments)


def orphaned_takes(takes: DataFrame, segments: DataFrame) -> DataFrame:
    """Takes without a segment any more: what a rebuild of a book leaves to drop, beside ``plan_reprocess``."""
    return takes.join(segments.select(F.col("id").alias("segment_id")), "segment_id", "left_anti")
