"""An inventory of objects by listing a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, bytes, modified_at): the files under ``root`` with their path below it as the key.

    As in every file source of Spark, hidden files (``_`` or ``.`` before the name) and empty ones are left out.

    Spark lists the folders, in parallel where there are many, and hands each task its share of the files; contents are
    never opened, since the column that holds them is not asked for. Characters that the path escapes are given back.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    anchor = root.rstrip("/").split("://")[-1].lstrip("/") + "/"  # the path as given, whatever scheme Spark puts before it
    path = F.col("path")
    return files.select(
        F.substring(path, F.locate(anchor, path) + F.lit(len(anchor)), F.length(path)).alias("key"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
