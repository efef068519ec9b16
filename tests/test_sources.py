"""Log records over the splits of files, and events by day."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.sources import events as event_files
from corpuskit.plans import registry
from corpuskit.sources import logs, migrate, objects

HEAD = "2024-01-01 00:00:{:02d},{:03d} {} app.x: {}"


def assemble(text, chars):
    """Records of one file by one loop."""
    out = []
    for line in text.split("\n")[:-1]:
        m = logs.OPENS.fullmatch(line)
        if m:
            out.append([*m.groups(), [], 1])
        elif out:
            out[-1][4].append(line)
            out[-1][5] += 1
        else:
            out.append([None] * 4 + [[line], 1])
    return sorted((str(r[0]), r[1], r[2], r[3], "\n".join(r[4])[:chars] if r[4] else None, r[5]) for r in out)


@pytest.mark.parametrize("split,chars", [("200b", 16000), ("1000b", 60), ("128m", 16000)])
def test_records_across_splits(spark, tmp_path, split, chars):
    rng = random.Random(4)
    texts = []
    for f in range(4):
        lines = ["cut off, no time here", ""] if f % 2 else []
        for i in range(150):
            lines.append(HEAD.format(i % 60, i, rng.choice(["INFO", "ERROR"]), f"message {i} é: {'x' * rng.randint(0, 40)}"))
            lines += rng.choice([[], [], ["Traceback (most recent call last):", "", "ValueError: bad value at: y"], ["  at"] * 30])
        texts.append("\n".join(lines) + "\n")
        (tmp_path / f"app{f}.log").write_text(texts[-1], encoding="utf-8")
    (tmp_path / "empty.log").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        got = logs.read_log_records(spark, str(tmp_path), chars).collect()
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)
    assert split == "128m" or splits > 12
    for f, text in enumerate(texts):
        mine = [(str(r.ts), r.level, r.logger, r.message, r.traceback, r.lines) for r in got if r.file.endswith(f"app{f}.log")]
        assert sorted(mine, key=str) == sorted(assemble(text, chars), key=str)
    assert not [r for r in got if r.file.endswith("empty.log")]


def events(spark, n, start=0):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, "error" if i % 10 == 0 else "info", base + datetime.timedelta(minutes=i * 7 % 28800)) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "id long, level string, created_at timestamp_ntz")


def newest(df, n, level=None):
    rows = [(r.created_at, r.id) for r in df.collect() if level in (None, r.level) and r.created_at]
    return [i for _, i in sorted(rows, reverse=True)[:n]]


def test_only_the_days_that_hold_the_newest(spark, tmp_path):
    path, first, late = str(tmp_path / "log"), events(spark, 4000), events(spark, 1000, 4000)
    event_files.write_events(first, path, 0)
    assert [r.id for r in event_files.newest_events(spark, path, 50, "error").collect()] == newest(first, 50, "error")
    for _ in range(2):  # a batch that comes again replaces itself
        event_files.write_events(late, path, 1)
    every = first.unionByName(late)
    for n, level in ((50, "error"), (500, None), (1, "info"), (10_000, None), (5, "none")):
        assert [r.id for r in event_files.newest_events(spark, path, n, level).collect()] == newest(every, n, level)
    assert spark.read.parquet(f"{path}/events").count() == 5000
    read = event_files.newest_events(spark, path, 50, "error")
    plan = read._jdf.queryExecution().toString()
    day = event_files.oldest_day_needed(spark, path, "error", 50)
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan and str(day) in plan
    assert spark.read.parquet(f"{path}/events").where(F.col("day") >= F.lit(day)).count() < 1500


def test_events_without_a_time_come_last(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = events(spark, 20).unionByName(events(spark, 2, 20).withColumn("created_at", F.lit(None).cast("timestamp_ntz")))
    event_files.write_events(rows, path, 0)
    assert [r.id for r in event_files.newest_events(spark, path, 22).collect()] == newest(rows, 20) + [21, 20]
    assert [r.id for r in event_files.newest_events(spark, path, 20).collect()] == newest(rows, 20)


def test_listing_opens_no_file(spark, tmp_path):
    names = {"a.txt": 3, "deep/er/b c.txt": 1, "deep/ü%41.txt": 7}
    for name, size in {**names, "empty.txt": 0}.items():
        (tmp_path / "store" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "store" / name).write_bytes(b"x" * size)
    (tmp_path / "store" / "_hidden").write_text("no")
    listed = objects.list_objects(spark, str(tmp_path / "store"))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert {r.key: r.bytes for r in listed.collect()} == names
    assert {r.key for r in objects.list_objects(spark, f"file://{tmp_path}/store/").collect()} == set(names)


def test_remap_joins_only_what_can_match(spark, sf_dir):
    """Counts join the local clips alone, with keys of their form; ids are moved without the target's keys."""
    v = registry.derived(spark, sf_dir)
    inv = v("inventory")
    found = migrate.remap_ids(v("books"), v("segments"), inv, inv, 2)
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in found.items()}
    assert "_there" not in plans["segments"] and "RLIKE" in plans["counts"] and "concat(\0" not in plans["counts"]
    segs = spark.createDataFrame(
        [(1, 1, 0, "storage/audio/1/0000.mp3"), (2, 1, 1, "storage/audio/1/0001.mp3"), (3, 1, 2, "storage/audio/x"), (4, 1, 3, None), (5, 1, 4, "audio/1/0004.mp3")],
        "id long, book_id long, seg_order int, audio_path string").selectExpr("*", "'t' AS text", "'s' AS status", "1.0 AS duration")
    here = spark.createDataFrame([("storage/audio/1/0000.mp3",), ("storage/audio/1/0001.mp3",), ("audio/1/0004.mp3",)] * 2, "key string")
    there = spark.createDataFrame([("audio/3/0001.mp3",), ("audio/3/alder/0000.mp3",), (None,)], "key string")
    small = migrate.remap_ids(spark.createDataFrame([(1,)], "id long"), segs, here, there, 2)
    assert small["counts"].first().asDict() == {"uploaded": 1, "skipped": 1, "missing": 1}
    assert [r.audio_path for r in small["segments"].orderBy("id").collect()] == [
        "audio/3/0000.mp3", "audio/3/0001.mp3", None, None, "audio/1/0004.mp3"]
