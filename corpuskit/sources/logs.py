"""Log files: records of several lines, put together across the splits of a file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.monitor import TRACEBACK_CHARS
from ..session import scratch_dir

# Fixed value: how a record's first line starts (asctime, level, logger). Later lines have no time of their own.
OPENS = re.compile(r"(?s)(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) (\S+) (\S+): (.*)")
SCHEMA = "file string, start long, piece int, ts string, level string, logger string, message string, traceback string, lines long"
_COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


class _Record:
    """A record as it is read: its header (none for lines before a split's first), its first ``chars`` further characters."""

    def __init__(self, file: str, start: int, header: tuple | None, chars: int):
        self.file, self.start, self.header, self.room, self.rest = file, start, header, chars, []
        self.lines = 0 if header is None else 1

    def add(self, line: str) -> None:
        self.lines += 1
        if self.room >= 0:  # none left: the line break before it still counts
            self.rest.append(line[: self.room])
            self.room -= len(line) + 1

    def row(self, piece: int) -> tuple:
        traceback = "\n".join(self.rest) if self.rest else None
        return (self.file, self.start, piece, *(self.header or (None,) * 4), traceback, self.lines)


def _records(chars: int):
    """Rows of a task's splits, whose lines come in order. piece 0 is a split's lines before its first record, 1 its last
    record, which the next split may go on with, 2 every other record."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            rows = []
            for file, start, line in zip(batch["file"], batch["start"], batch["value"], strict=True):
                if now is None or (now.file, now.start) != (file, start):
                    if now is not None and now.lines:
                        rows.append(now.row(int(now.header is not None)))
                    now = _Record(file, start, None, chars)
                opened = OPENS.match(line)
                if opened:
                    if now.lines:
                        rows.append(now.row(0 if now.header is None else 2))
                    now = _Record(file, start, opened.groups(), chars)
                else:
                    now.add(line)
            yield pd.DataFrame(rows, columns=_COLUMNS)
        if now is not None and now.lines:
            yield pd.DataFrame([now.row(int(now.header is not None))], columns=_COLUMNS)

    return read


def read_log_records(spark: SparkSession, path: str, chars: int = TRACEBACK_CHARS) -> DataFrame:
    """file, ts, level, logger, message, traceback, lines: the records of the log files under ``path``.

    A line that does not start as a record does belongs to the record above it, wherever a split of the file ends; the
    traceback is these lines, cut at ``chars`` as everywhere, null without any. Lines above a file's first record are a
    record without header. Files are read in one pass without a shuffle; only the first lines and the last record of
    each split go through an exchange, two rows a split at most. Empty files have no records.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    staged = scratch_dir(spark, "log-records")
    lines.mapInPandas(_records(chars), SCHEMA).write.parquet(staged)
    found = spark.read.schema(SCHEMA).parquet(staged)
    ends = found.where("piece < 2")
    order = Window.partitionBy("file").orderBy("start", "piece")  # two rows for each split of the file
    opened = ends.withColumn("nth", F.sum("piece").over(order))
    part = F.struct("start", "piece", "traceback")
    header = {name: F.max(name).alias(name) for name in ("ts", "level", "logger", "message")}  # one row of each has them
    joined = opened.groupBy("file", "nth").agg(
        *header.values(), F.sort_array(F.collect_list(part)).alias("parts"), F.sum("lines").alias("lines"))
    bodies = F.filter(F.col("parts.traceback"), lambda t: t.isNotNull())
    traceback = F.when(F.size(bodies) > 0, F.substring(F.array_join(bodies, "\n"), 1, chars))
    names = ("file", "ts", "level", "logger", "message", "traceback", "lines")
    return found.where("piece = 2").select(*names).unionByName(joined.withColumn("traceback", traceback).select(*names))
