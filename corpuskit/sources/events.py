"""Events by day: the newest rows are found from counts kept beside them, before any event is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_events(events: DataFrame, path: str, batch: int) -> None:
    """Add a batch of events (id, level, created_at and others) to the days they belong to, late ones included.

    Files are sorted by level and time; a day's rows are spread over all partitions, so a day that holds a third of
    them is no single task. The same batch written again replaces its own rows. Counts per day and level follow the
    events: a batch that dies in between is read as uncounted, which only means that more days are read.
    """
    days = events.withColumns({"day": F.to_date("created_at"), "batch": F.lit(batch)})
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = days.repartition(parts, "day", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions(
        "day", "level", F.desc("created_at"))
    replace = {"partitionOverwriteMode": "dynamic"}
    spread.write.mode("overwrite").options(**replace).partitionBy("batch", "day").parquet(f"{path}/events")
    counts = days.groupBy("batch", "day", "level").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.mode("overwrite").options(**replace).partitionBy("batch").parquet(f"{path}/counts")


def oldest_day_needed(spark: SparkSession, path: str, level: str | None, n: int):
    """The latest day from which on the counts reach ``n`` events, or None if all days together hold fewer.

    Events without a time sort last and have no day, so they count for none.
    """
    counts = spark.read.parquet(f"{path}/counts").where("day IS NOT NULL")
    if level:
        counts = counts.where(F.col("level") == level)
    days = counts.groupBy("day").agg(F.sum("n").alias("n"))  # a row for each day there is
    total = F.sum("n").over(Window.orderBy(F.desc("day")))
    return days.withColumn("total", total).where(F.col("total") >= n).agg(F.max("day")).head()[0]


def newest_events(spark: SparkSession, path: str, n: int, level: str | None = None) -> DataFrame:
    """The ``n`` newest events of a level (or all), newest first, then by id; reads only the days that hold them."""
    events = spark.read.parquet(f"{path}/events")
    if level:
        events = events.where(F.col("level") == level)
    day = oldest_day_needed(spark, path, level, n)
    if day is not None:
        events = events.where(F.col("day") >= F.lit(day))
    return events.drop("batch", "day").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
