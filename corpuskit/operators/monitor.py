"""Pipeline events, host health, liveness, logs, queues and workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import let, none_if_empty
from .ranking import newest_per_group

# --- fixed values ---------------------------------------------------------------------------
MESSAGE_CHARS = 4000
TRACEBACK_CHARS = 16000
MEM_LIMITS = (80.0, 92.0)
SWAP_LIMITS = (50.0, 80.0)
LOAD_LIMITS = (1.5, 3.0)
HEARTBEAT_TTL_S = 120
SEVERITIES = ("ok", "warn", "critical")
NO_HEARTBEAT = "no heartbeat in the last 2 minutes"
QUEUES = ("synth", "ingest", "celery")
LOG_KEEP = 1000
LOG_LINE = r"(?s)^(\S+ \S+) (\S+) (\S+): (.*)$"
# --------------------------------------------------------------------------------------------
#: Slots of one slice of a host's history.
SLICE_SLOTS = 4096


def record_events(
    events: DataFrame, message_chars: int = MESSAGE_CHARS, traceback_chars: int = TRACEBACK_CHARS
) -> DataFrame:
    """Event rows as stored: message never null; both texts are cut at ``message_chars`` and ``traceback_chars``."""
    return events.withColumns(
        {
            "message": F.substring(F.coalesce("message", F.lit("")), 1, message_chars),
            "traceback": none_if_empty(F.substring("traceback", 1, traceback_chars)),
        }
    )


def recent_events(
    events: DataFrame, books: DataFrame, level: str | None = None, book_id: int | None = None, limit: int = 100
) -> DataFrame:
    """The newest events, with the book's title (null once the book is gone).

    The limit comes first, so that the title join sees at most ``limit`` rows.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    if level:
        events = events.filter(F.col("level") == level)
    if book_id is not None:
        events = events.filter(F.col("book_id") == book_id)
    newest = events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    titles = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    return newest.join(titles, "book_id", "left").select(
        "id", "book_id", "book_title", "task", "level", "message", "traceback", "created_at"
    ).orderBy(F.desc("created_at"), F.desc("id"))


def errors_only(recent: DataFrame) -> DataFrame:
    """Errors among the events shown, hence after their limit."""
    return recent.filter(F.col("level") == "error")


def _severity(value: Column, limits: tuple[float, float]) -> Column:
    warn, critical = limits
    return F.when(value >= critical, 2).when(value >= warn, 1).otherwise(0)


def round_cents(c: Column) -> Column:
    """A double to two digits by its exact binary value: 1.575, whose double lies below, gives 1.57; 0.125 gives 0.12.

    ``bround`` rounds the shortest decimal form. Both differ only where that form is a tie, k + 5 thousandths; there
    the sign of value * 1000 - thousandths, computed without error from two halves of the double, decides.
    """

    def decide(v: Column) -> Column:
        thousandths = F.rint(v["x"] * 1000.0)
        scaled = v["x"] * 134217729.0
        high = scaled - (scaled - v["x"])
        rest = (high * 1000.0 - thousandths) + (v["x"] - high) * 1000.0
        below = (thousandths - 5.0) / 10.0
        tie = (v["x"] == thousandths / 1000.0) & (F.pmod(thousandths, F.lit(10.0)) == 5.0) & (rest != 0)
        return F.when(tie, (below + (rest > 0).cast("double")) / 100.0).otherwise(F.bround(v["x"], 2))

    return let(F.struct(c.cast("double").alias("x")), decide)


def classify_host(metrics: DataFrame) -> DataFrame:
    """Add severity and reasons of a host snapshot (mem_pct, swap_pct, load1, cpus)."""
    per_cpu = round_cents(F.col("load1") / F.col("cpus"))
    checks = (
        (F.col("mem_pct"), MEM_LIMITS, "memory at ", "%"),
        (F.col("swap_pct"), SWAP_LIMITS, "swap at ", "%"),
        (per_cpu, LOAD_LIMITS, "load ", "x per cpu"),
    )
    worst = F.greatest(*(_severity(value, limits) for value, limits, _, _ in checks))
    reasons = F.array_compact(
        F.array(
            *(
                F.when(value >= limits[0], F.concat(F.lit(before), value.cast("string"), F.lit(after)))
                for value, limits, before, after in checks
            )
        )
    )
    name = F.get(F.array(*map(F.lit, SEVERITIES)), worst)
    return metrics.withColumns({"severity": name, "reasons": reasons})


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def host_report(metrics: DataFrame, hosts: DataFrame, as_of: Column) -> DataFrame:
    """Latest snapshot per known host; without one in 120 s the host is offline with a warning.

    ``hosts`` has one row per host. ``overall`` repeats the worst severity of the report on each row.
    """
    latest = metrics.filter(F.col("seen_at") <= as_of).groupBy("host").agg(
        F.max(F.struct("seen_at", "mem_pct", "swap_pct", "load1", "cpus")).alias("m")
    )
    aged = latest.select("host", "m.*", (_seconds(as_of) - _seconds(F.col("m.seen_at"))).alias("age"))
    alive = classify_host(aged.filter(F.col("age") < HEARTBEAT_TTL_S))
    report = hosts.join(alive, "host", "left").select(
        "host",
        F.col("seen_at").isNotNull().alias("online"),
        F.bround("age").cast("bigint").alias("age_s"),
        F.coalesce("severity", F.lit("warn")).alias("severity"),
        F.coalesce("reasons", F.array(F.lit(NO_HEARTBEAT))).alias("reasons"),
    )
    codes = F.array(*map(F.lit, SEVERITIES))
    worst = report.select(F.get(codes, F.max(F.array_position(codes, F.col("severity")) - 1).cast("int")))
    return report.withColumn("overall", worst.scalar())


def critical_banner(report: DataFrame) -> DataFrame:
    """One line per critical host of a report, ready to be shown side by side."""
    return report.filter(F.col("severity") == "critical").select(
        "host", F.concat("host", F.lit(": "), F.array_join("reasons", ", ")).alias("banner")
    ).orderBy("host")


def liveness_sessions(beats: DataFrame, ttl: int = HEARTBEAT_TTL_S, slice_slots: int = SLICE_SLOTS) -> DataFrame:
    """Intervals in which a host was alive: each beat keeps it alive for ``ttl`` seconds.

    Beats in one slot of ``ttl`` seconds always belong together, so each slot is reduced to its first and last beat
    before anything is sorted; a chatty host costs one row per slot. A host's slots are numbered within slices of
    ``slice_slots`` of them, and of each slice only its ends and its number of sessions are set against the slice
    before: the longest window has a host's slices, not its slots.
    """
    at_us = F.unix_micros(F.col("seen_at").cast("timestamp"))
    span = ttl * 1_000_000
    slots = beats.groupBy("host", F.floor(at_us / F.lit(span)).alias("slot")).agg(
        F.min(at_us).alias("first_us"), F.max(at_us).alias("last_us"), F.count(F.lit(1)).alias("beats")
    ).withColumn("slice", F.floor(F.col("slot") / slice_slots))
    inside = Window.partitionBy("host", "slice").orderBy("slot")
    gap = (F.col("first_us") - F.lag("last_us").over(inside) > span).cast("int")  # null at a slice's first slot
    opened = slots.withColumn("opens", F.coalesce(gap, F.lit(0))).withColumn("nth", F.sum("opens").over(inside))
    across = Window.partitionBy("host").orderBy("slice")
    joins = F.coalesce(F.col("first") - F.lag("last").over(across) > span, F.lit(True)).cast("int")
    ends = opened.groupBy("host", "slice").agg(
        F.min("first_us").alias("first"), F.max("last_us").alias("last"), F.sum("opens").alias("n")
    ).withColumn("joins", joins).select(
        F.col("host").alias("_host"), F.col("slice").alias("_slice"),
        (F.sum(F.col("joins") + F.col("n")).over(across) - F.col("n")).alias("before"),
    )
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("slice").eqNullSafe(F.col("_slice"))
    numbered = opened.join(ends, same).withColumn("session", F.col("before") + F.col("nth"))
    return numbered.groupBy("host", "session").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("beats").alias("beats")
    ).select(
        "host",
        F.timestamp_micros("first_us").cast("timestamp_ntz").alias("alive_from"),
        F.timestamp_micros(F.col("last_us") + span).cast("timestamp_ntz").alias("alive_until"),
        "beats",
    )


def outages(sessions: DataFrame) -> DataFrame:
    """Gaps between the alive intervals of a host."""
    by_host = Window.partitionBy("host").orderBy("alive_from")
    return sessions.withColumn("back_at", F.lead("alive_from").over(by_host)).filter(
        F.col("back_at").isNotNull()
    ).select("host", F.col("alive_until").alias("down_from"), "back_at")


def parse_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Split ``asctime level logger: message``."""
    names = ("ts", "level", "logger", "message")
    return lines.withColumns(
        {name: F.regexp_extract(column, LOG_LINE, i + 1) for i, name in enumerate(names)}
    )


def tail_logs(logs: DataFrame, source: str, n: int = 200) -> DataFrame:
    """The last ``n`` lines of a source, oldest first."""
    if not 10 <= n <= 1000:
        raise ValueError("n must lie between 10 and 1000")
    newest = logs.filter(F.col("source") == source).orderBy(F.desc("seen_at"), F.desc("id")).limit(n)
    return newest.orderBy("seen_at", "id")


def cap_log(logs: DataFrame, n: int = LOG_KEEP) -> DataFrame:
    """The newest ``n`` lines of every source."""
    return newest_per_group(logs, "source", [F.desc("seen_at"), F.desc("id")], n)


def queue_depth(items: DataFrame, queues: Sequence[str] = QUEUES) -> DataFrame:
    """Items waiting per named queue, zero included, and their total."""
    named = items.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, queues))).alias("queue"))
    counts = items.filter(F.col("queue").isin(*queues)).groupBy("queue").agg(F.count(F.lit(1)).alias("n"))
    filled = named.join(counts, "queue", "left").select("queue", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.rollup("queue").agg(F.sum("n").alias("n")).select(F.coalesce("queue", F.lit("total")).alias("queue"), "n")


def short_worker(name: Column) -> Column:
    return F.when(name.contains("@"), F.split_part(name, F.lit("@"), F.lit(2))).otherwise(name)


def short_task(task: Column) -> Column:
    return F.coalesce(F.substring_index(none_if_empty(task), ".", -1), F.lit("?"))


def worker_rollup(items: DataFrame) -> DataFrame:
    """Per worker: tasks done, reserved and active, sorted by name."""
    state = F.col("state")
    return items.groupBy("worker").agg(
        F.count_if(state == "done").alias("processed"),
        F.count_if(state == "reserved").alias("reserved"),
        F.count_if(state == "active").alias("active"),
    ).select(short_worker(F.col("worker")).alias("name"), "worker", "processed", "reserved", "active").orderBy("name", "worker")


def worker_active(items: DataFrame, as_of: Column) -> DataFrame:
    """The running tasks with their run time; a row each, since a worker may hold very many."""
    runtime = F.greatest(F.lit(0.0), _seconds(as_of) - _seconds(F.col("started")))
    return items.filter(F.col("state") == "active").select(
        "id",
        short_worker(F.col("worker")).alias("name"),
        short_task(F.col("task")).alias("task"),
        F.when(F.col("started").isNotNull(), runtime).alias("runtime_s"),
    )


def format_clock(seconds: Column) -> Column:
    """``m:ss``; unknown, infinite or negative times show as 0:00."""
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    whole = F.floor(seconds)
    return F.when(bad, "0:00").otherwise(F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))


def format_uptime(seconds: Column) -> Column:
    """``s``, ``m s``, ``h m`` or ``d h``; a dash for none. Halves round up."""

    def ladder(n: Column) -> Column:
        hours = F.floor(n / 3600)
        return (
            F.when(n < 60, F.format_string("%ds", n))
            .when(n < 3600, F.format_string("%dm %ds", F.floor(n / 60), n % 60))
            .when(hours < 48, F.format_string("%dh %dm", hours, F.floor(n % 3600 / 60)))
            .otherwise(F.format_string("%dd %dh", F.floor(hours / 24), hours % 24))
        )

    return F.when(seconds.isNull(), "—").otherwise(let(F.floor(seconds + 0.5), ladder))


def failure_fallback(failures: DataFrame) -> DataFrame:
    """Event rows for task failures: (id, task?, exception?, info?, first_arg?)."""
    return failures.select(
        "id",
        F.col("first_arg").try_cast("bigint").alias("book_id"),
        F.coalesce(none_if_empty(F.col("task")), F.lit("unknown")).alias("task"),
        F.lit("error").alias("level"),
        F.coalesce(F.substring("exception", 1, MESSAGE_CHARS), F.lit("Task failed")).alias("message"),
        none_if_empty(F.substring("info", 1, TRACEBACK_CHARS)).alias("traceback"),
    )
