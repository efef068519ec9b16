"""Positions inside a group that may be very large.

A plain ``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends a whole key to one task. Here a
group is cut into buckets of consecutive order values; only one summary row per bucket goes through
the window over the whole key, and rows are numbered within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 4096


def number_in_group(
    df: DataFrame,
    key: str,
    order: str,
    carry: Column | None = None,
    bucket_width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add ``idx`` (0-based position in the group) and ``group_n`` (its size).

    ``order`` is an integer column, unique within the group up to duplicates that fit a task. With
    ``carry`` a column ``carried`` is added: the last non-null value of it at or before the row.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / bucket_width))
    if carry is not None:
        rows = rows.withColumn("_carry", carry)
    marks = [F.count(F.lit(1)).alias("_n")]
    if carry is not None:
        marks.append(F.expr(f"max_by(_carry, {order}) FILTER (WHERE _carry IS NOT NULL)").alias("_last"))
    across = Window.partitionBy(key).orderBy("_bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        rows.groupBy(key, "_bucket")
        .agg(*marks)
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("group_n", F.sum("_n").over(Window.partitionBy(key)))
    )
    if carry is not None:
        summary = summary.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    out = rows.join(summary.drop("_n"), [key, "_bucket"]).withColumn(
        "idx", F.col("_offset") + F.row_number().over(inside) - 1
    )
    if carry is not None:
        running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(
            "carried", F.coalesce(F.last("_carry", ignorenulls=True).over(running), F.col("_before"))
        )
    return out.drop("_bucket", "_offset", "_carry", "_before")


def newest_per_group(df: DataFrame, key: str, newest_first: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group: cut per salt first, so that no task sees a whole hot group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    for window in (Window.partitionBy(key, "_salt"), Window.partitionBy(key)):
        salted = salted.withColumn("_rn", F.row_number().over(window.orderBy(*newest_first))).filter(
            F.col("_rn") <= n
        )
    return salted.drop("_salt", "_rn")
