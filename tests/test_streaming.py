"""Streams over beats that come late, out of order, twice, and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.streaming import jobs

TTL, LATE = 120, 120
BEAT = "host string, seen_at timestamp, n int"


def edges_of(beats, end):
    """Edges up to `end`, which is where the watermark stands."""
    out = []
    for host in {h for h, _ in beats}:
        times = sorted({t for h, t in beats if h == host})
        for a, b in zip([None, *times], [*times, None], strict=True):
            if b is not None and (a is None or b - a > TTL):
                out.append((host, "online", b))
            if a is not None and (b is None or b - a > TTL):
                out.append((host, "offline", a + TTL))
    return sorted(e for e in out if e[2] <= end)


def send(spark, folder, batches):
    for batch in batches:
        rows = spark.createDataFrame([(h, t) for h, t in batch], "host string, t long")
        rows.select("host", F.timestamp_seconds("t").alias("seen_at"), F.lit(1).alias("n")).coalesce(1).write.mode(
            "append").parquet(folder)


def drained(spark, base):
    stream = jobs.file_source(spark, f"{base}/in", "*.parquet", BEAT, maxFilesPerTrigger="1")
    jobs.start_expiry(stream, f"{base}/out", f"{base}/check").awaitTermination()
    rows = spark.read.parquet(f"{base}/out").select("host", "status", F.unix_seconds("at").alias("at")).collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("seed", [0, 1])
def test_expiry_over_restarts(spark, tmp_path, seed):
    """Batches overlap by less than the watermark's delay, beats repeat, the query starts anew between them."""
    rng = random.Random(seed)
    start, beats = 1_700_000_000, []
    for host in "abcd":
        t = start + rng.randint(0, 60)
        while t < start + 3000:
            beats.append((host, t))
            t += rng.choice([30, 30, 30, 120, 121, 200, 500])
    beats += rng.choices(beats, k=10)
    beats.sort(key=lambda b: b[1] + rng.randint(0, 100))
    cut = [beats[i : i + 20] for i in range(0, len(beats), 20)]
    base, sent = str(tmp_path), []
    for part in (cut[:2], cut[2:3], cut[3:]):
        send(spark, f"{base}/in", part)
        sent += [b for batch in part for b in batch]
        got = drained(spark, base)
        assert got == edges_of(sent, max(t for _, t in sent) - LATE)
    assert {s for _, s, _ in got} == {"online", "offline"}


def test_a_host_that_stops_is_offline_without_a_beat_of_its_own(spark, tmp_path):
    base, sent = str(tmp_path), []
    for batches in ([[("a", 1000), ("a", 1000), ("b", 1000)], [("b", 1239)]], [[("b", 1241), ("b", None), (None, 1241)]],
                    [[("a", 1300), ("b", 1300)], [("b", 1420)]]):
        send(spark, f"{base}/in", batches)
        sent += [x for batch in batches for x in batch if None not in x]
        got = drained(spark, base)
        assert got == edges_of(sent, max(t for _, t in sent) - LATE)
        assert (("a", "offline", 1120) in got) == (len(sent) > 4)
    assert got[-1] == ("b", "online", 1239) and ("a", "online", 1300) in got


def test_beats_behind_the_watermark_are_dropped(spark, tmp_path):
    base = str(tmp_path)
    send(spark, f"{base}/in", [[("a", 1000)], [("b", 2000)], [("a", 1500), ("c", 1880), ("c", 1881)], [("b", 2100)]])
    assert drained(spark, base) == [("a", "offline", 1120), ("a", "online", 1000), ("c", "online", 1881)]


def test_counts_follow_the_changes(spark, tmp_path):
    """Equal to a recount after every run; late and repeated changes and a replayed batch change nothing."""
    from corpuskit.sources.tables import append_changes

    rng, base, sent = random.Random(5), str(tmp_path), []
    schema = "segment_id long, book_id long, status string, version long, extra int"
    for run in range(3):
        batches = [[(rng.choice([None, *range(40)]), rng.randrange(3), rng.choice(["queued", "ready", "failed", None]),
                     rng.choice([None, rng.randrange(200)]), 1) for _ in range(60)] for _ in range(2)]
        for batch in batches:
            spark.createDataFrame(batch + batch[:5], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
            sent += batch
        stream = jobs.file_source(spark, f"{base}/in", "*.parquet", schema, maxFilesPerTrigger="1")
        jobs.start_counts(stream, f"{base}/out", f"{base}/check", "segment_id", ["book_id", "status"], "version").awaitTermination()
        last = {}
        for segment, book, status, version, _ in sent:
            if segment is not None and version is not None:
                place = (version, f'{{"book_id":{book},"status":{"null" if status is None else chr(34) + status + chr(34)}}}', book, status)
                last[segment] = max(last.get(segment, place), place, key=lambda p: p[:2])
        want = {}
        for *_, book, status in last.values():
            want[book, status] = want.get((book, status), 0) + 1
        got = jobs.counts(spark, f"{base}/out", "book_id long, status string").collect()
        assert {(r.book_id, r.status): r.n for r in got} == want and len(got) == len(want)
    written = spark.read.parquet(f"{base}/out/changes").groupBy("batch").count().collect()
    assert len(written) == 6 and max(r["count"] for r in written) <= 12
    replayed = spark.createDataFrame(spark.read.parquet(f"{base}/out/changes/batch=5").collect())
    append_changes(replayed, f"{base}/out", 5)
    again = jobs.counts(spark, f"{base}/out", "book_id long, status string").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
