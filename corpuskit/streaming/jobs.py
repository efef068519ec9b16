"""Event ingest, heartbeats, liveness, redelivery-safe ingest, upserts, capped logs, status polls.

Sources are streaming DataFrames with TIMESTAMP event times. Upserts keep no stream state: each micro-batch is
reduced to one row per key and appended under its number, so that its cost follows the batch, not the table, and the
same batch may come again without harm. Readers reduce the batches (``tables.read_state``); ``tables.compact`` folds
them into a version from time to time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import catalog, monitor, votes
from ..sources.tables import append_changes, read_state, write_segments

REDELIVERY = "2 hours"
LATE_BEATS = "2 minutes"


def file_source(spark: SparkSession, folder: str, pattern: str, schema: Any, **options: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(folder)


def _trigger(processing_time: str | None) -> dict[str, Any]:
    return {"processingTime": processing_time} if processing_time else {"availableNow": True}


def _each_batch(stream: DataFrame, checkpoint: str, every: str | None, work) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def start_event_ingest(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append pipeline events, cut to their stored lengths."""
    return (
        monitor.record_events(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def latest_per_host(beats: DataFrame) -> DataFrame:
    """The last snapshot of each host; of several at the same time the largest, so that a replay gives the same."""
    values = [c for c in beats.columns if c not in ("host", "seen_at")]
    last = beats.groupBy("host").agg(F.max(F.struct("seen_at", *values)).alias("m")).select("host", "m.*")
    return last.select(*beats.columns)


def start_heartbeats(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep the latest snapshot of every host; read by ``latest_per_host``."""
    return _each_batch(stream, checkpoint, every, lambda batch, n: append_changes(latest_per_host(batch), sink, n))


def start_liveness(
    stream: DataFrame, sink: str, checkpoint: str, every: str | None = None, ttl: int = monitor.HEARTBEAT_TTL_S
) -> StreamingQuery:
    """Closed alive intervals per host. Beats later than the watermark are dropped.

    With spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition set in the session, sessions are merged
    before the shuffle, so a chatty host sends few rows; ``build_session`` sets it.
    """
    sessions = (
        stream.withWatermark("seen_at", LATE_BEATS)
        .groupBy("host", F.session_window("seen_at", f"{ttl} seconds").alias("alive"))
        .agg(F.count(F.lit(1)).alias("beats"))
        .select("host", F.col("alive.start").alias("alive_from"), F.col("alive.end").alias("alive_until"), "beats")
    )
    return (
        sessions.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


class _Presence(StatefulProcessor):
    """Alive intervals of one host that are not settled, and timers at their next edges.

    An edge (first beat, or ``ttl`` after the last one) is settled and given out once the watermark has passed it,
    since until then an earlier or a joining beat may come. So a host holds only the intervals of its last minutes,
    and nothing once it has gone offline.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.alive = handle.getListState("alive", "first_us long, last_us long, shown boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        beats = sorted(t for batch in rows for t in batch["seen_us"].tolist() if t > now_us)
        held = [tuple(r) for r in self.alive.get()] if self.alive.exists() else []
        merged: list[list] = []
        for first, last, shown in sorted([*held, *((t, t, False) for t in beats)]):
            if merged and first - merged[-1][1] <= self.ttl_us:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last, shown])
        yield from self._settle(key[0], merged, now_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [list(r) for r in self.alive.get()] if self.alive.exists() else []
        yield from self._settle(key[0], held, timerValues.getCurrentWatermarkInMs() * 1000)

    def _settle(self, host: str, intervals: list[list], now_us: int) -> Iterator[pd.DataFrame]:
        out, kept, edges = [], [], set()
        for first, last, shown in intervals:
            if not shown and first <= now_us:
                out.append((host, "online", first))
                shown = True
            if last + self.ttl_us <= now_us:
                out.append((host, "offline", last + self.ttl_us))
                continue
            kept.append((first, last, shown))
            edges.add((last + self.ttl_us + 999) // 1000)
            if not shown:
                edges.add((first + 999) // 1000)
        if kept:
            self.alive.put(kept)
        else:
            self.alive.clear()
        known = set(self.handle.listTimers())
        for at in known - edges:
            self.handle.deleteTimer(at)
        for at in edges - known:
            self.handle.registerTimer(at)
        if out:
            yield pd.DataFrame(out, columns=["host", "status", "at_us"])

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_expiry(
    stream: DataFrame, sink: str, checkpoint: str, every: str | None = None, ttl: int = monitor.HEARTBEAT_TTL_S
) -> StreamingQuery:
    """An `offline` row ``ttl`` seconds of event time after a host's last beat, an `online` row for its first one.

    Rows: host, status, at. They come when the watermark, LATE_BEATS behind the newest beat of any host, has passed
    ``at``: a stopped host needs no further beat of its own. Beats may come out of order and more than once within
    that time, later ones are dropped. State is kept by host; each beat moves the host's timers. Beats without host
    or time are left out.
    """
    spark = stream.sparkSession
    beats = stream.where("host IS NOT NULL AND seen_at IS NOT NULL").withWatermark("seen_at", LATE_BEATS).select(
        "host", "seen_at", F.unix_micros("seen_at").alias("seen_us"))
    edges = beats.groupBy("host").transformWithStateInPandas(
        _Presence(ttl * 1_000_000), "host string, status string, at_us long", "Append", "EventTime")
    return _with_rocks_db(spark, lambda: (
        edges.select("host", "status", F.timestamp_micros("at_us").alias("at"))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    ))


def _with_rocks_db(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query on the state store that a stateful processor needs; a query keeps the settings of its start."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class _Move(StatefulProcessor):
    """Where one thing is counted. A newer change takes it out there (-1) and counts it in its new place (+1)."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "version long, place string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max((version, place) for batch in rows for version, place in zip(batch["version"], batch["place"], strict=True))
        known = tuple(self.last.get()) if self.last.exists() else None
        if known is None or newest > known:
            self.last.update((int(newest[0]), newest[1]))
            if known is None or known[1] != newest[1]:
                yield pd.DataFrame(
                    [(newest[1], 1)] + ([(known[1], -1)] if known else []), columns=["place", "n"])

    def close(self) -> None:
        pass


def start_counts(
    stream: DataFrame, sink: str, checkpoint: str, key: str, groups: list[str], version: str, every: str | None = None
) -> StreamingQuery:
    """Counts of things per ``groups`` that follow their changes; read by ``counts``.

    A change has ``key`` (which thing), the group columns as they are now and ``version``, a long that grows with each
    change of a thing; the highest counts, whatever the order of arrival, of equal ones the greater groups. Changes
    without key or version are left out. The last place of each thing is state, so a batch costs its own changes, and
    at most two rows per group are written for it under its number: a batch that comes again replaces them.
    """
    changes = stream.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(version).cast("long").alias("version"),
        F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}).alias("place"))
    moves = changes.groupBy("key").transformWithStateInPandas(_Move(), "place string, n long", "Update", "None")

    def work(batch: DataFrame, n: int) -> None:
        append_changes(summed(batch), sink, n)

    return _with_rocks_db(stream.sparkSession, lambda: moves.writeStream.foreachBatch(work).outputMode("update").option(
        "checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def summed(rows: DataFrame) -> DataFrame:
    """Places with their counts, those that nothing is in any more left out."""
    return rows.groupBy("place").agg(F.sum("n").alias("n")).where("n <> 0")


def counts(spark: SparkSession, sink: str, groups: str) -> DataFrame:
    """The current counts; ``groups`` is the schema of the group columns."""
    return read_state(spark, sink, summed).select(F.from_json("place", groups).alias("g"), "n").select("g.*", "n")


def start_segment_ingest(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write delivered segments once, though a delivery may come again within two hours.

    ``stream``: delivery_id (one per segment sent), delivered_at, generation, and the segment columns. A book may come
    in any number of batches; only a newer generation of it replaces an older one.
    """
    once = stream.withWatermark("delivered_at", REDELIVERY).dropDuplicatesWithinWatermark(["delivery_id"])
    return _each_batch(once, checkpoint, every, lambda batch, n: write_segments(batch.drop("delivery_id"), sink, n))


def start_vote_upsert(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One vote per (test, user): last choice, first time; read by ``one_vote``."""
    return _each_batch(stream, checkpoint, every, lambda batch, n: append_changes(one_vote(batch), sink, n))


def one_vote(rows: DataFrame) -> DataFrame:
    return votes.upsert_votes(rows.limit(0), rows)


def latest_progress(rows: DataFrame) -> DataFrame:
    """Last write per (user, book); a record without a numeric position counts as none."""
    values = [c for c in rows.columns if c not in ("user_id", "book_id")]
    last = rows.groupBy("user_id", "book_id").agg(F.max_by(F.struct(*values), F.struct("updated", "id")).alias("p"))
    return last.select("user_id", "book_id", "p.*")


def playable_progress(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seg_idx", F.expr("try_cast(seg_idx AS INT)")).filter(F.col("seg_idx").isNotNull())


def start_progress_upsert(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep the last saved position per (user, book), malformed ones too: they hide older ones. Read by
    ``latest_progress``."""
    return _each_batch(stream, checkpoint, every, lambda batch, n: append_changes(latest_progress(batch), sink, n))


def start_capped_log(
    stream: DataFrame, sink: str, checkpoint: str, every: str | None = None, n: int = monitor.LOG_KEEP
) -> StreamingQuery:
    """The newest ``n`` lines per source; read by ``newest_lines``. A line that comes twice counts once."""
    return _each_batch(stream, checkpoint, every, lambda batch, k: append_changes(newest_lines(batch, n), sink, k))


def newest_lines(rows: DataFrame, n: int = monitor.LOG_KEEP) -> DataFrame:
    return monitor.cap_log(rows.dropDuplicates(["id"]), n)


def start_status_poll(
    stream: DataFrame, books_path: str, sink: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Count the books per status whenever events come in. Every count stays beside the earlier ones under its
    number (``batch``), so that no reader loses the files it reads; ``last_poll`` is the newest."""

    def work(batch: DataFrame, n: int) -> None:
        books = batch.sparkSession.read.parquet(books_path)
        append_changes(catalog.status_summary(books), sink, n)

    return _each_batch(stream, checkpoint, every, work)


def last_poll(spark: SparkSession, sink: str) -> DataFrame:
    polls = spark.read.parquet(f"{sink}/changes")
    return polls.filter(F.col("batch") == polls.agg(F.max("batch")).scalar()).drop("batch")
