"""Rules on small rows: edge cases, hot keys, repeated runs."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import chunks
from corpuskit.operators import catalog, corpus, monitor, planning, votes
from corpuskit.operators.ranking import newest_per_group, number_in_group
from corpuskit.plans import registry
from corpuskit.plans.registry import QUERIES
from corpuskit.session import scratch_dir
from corpuskit.sources import migrate, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_number_in_group_with_a_hot_group(spark):
    rng = random.Random(1)
    data = []
    for key, n in (("hot", 600), ("b", 7), ("c", 1)):
        orders = rng.sample(range(5000), n)
        data += [(key, o, f"t{o}" if rng.random() < 0.05 else None) for o in orders]
    df = spark.createDataFrame(data, "k string, o int, t string").repartition(7)
    got = {(r.k, r.o): (r.idx, r.group_n, r.carried) for r in number_in_group(df, "k", "o", F.col("t"), 16).collect()}
    for key in ("hot", "b", "c"):
        last, mine = None, sorted((o, t) for k, o, t in data if k == key)
        for i, (o, t) in enumerate(mine):
            last = t or last
            assert got[(key, o)] == (i, len(mine), last)


def test_newest_per_group(spark):
    df = spark.range(5000).select("id", (F.col("id") % 50 == 0).cast("string").alias("k"))
    got = rows(newest_per_group(df, "k", [F.desc("id")], 120))
    want = sorted([(i, "true") for i in range(0, 5000, 50)] + [(i, "false") for i in [j for j in range(5000) if j % 50][-120:]])
    assert got == want


def test_liveness_edges(spark):
    at = datetime.datetime(2024, 1, 1)
    beats = [("a", at + datetime.timedelta(seconds=s)) for s in (0, 60, 180, 301, 302)] + [("b", at)]
    df = spark.createDataFrame(beats, "host string, seen_at timestamp_ntz")
    got = [(h, (f - at).seconds, (u - at).seconds, n) for h, f, u, n in rows(monitor.liveness_sessions(df))]
    assert got == [("a", 0, 300, 3), ("a", 301, 422, 2), ("b", 0, 120, 1)]


def test_metadata(spark):
    cases = [
        ('{"author": " A ", "year": 1999.7}', ("A", None, 1999, None)),
        ('{"year": "1999.5"}', (None, None, None, None)),
        ('{"year": " 1999 "}', (None, None, 1999, None)),
        ('{"author": 0, "genre": "0", "notes": false}', (None, "0", None, None)),
        ('{"author": 5, "year": null}', ("5", None, None, None)),
        ("not json", (None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = catalog.parse_metadata(df, "raw").orderBy("i").collect()
    assert [(r.author, r.genre, r.year, r.notes) for r in got] == [c[1] for c in cases]


def test_formats(spark):
    df = spark.createDataFrame([(v,) for v in (None, 59.4, 59.5, 3599.0, 3600.0, 172799.0, 172800.0)], "s double")
    assert [r[0] for r in df.select(monitor.format_uptime(F.col("s"))).collect()] == [
        "—", "59s", "1m 0s", "59m 59s", "1h 0m", "47h 59m", "2d 0h"]
    df = spark.createDataFrame([(v,) for v in (None, -1.0, float("nan"), float("inf"), 61.9, 3600.0)], "s double")
    assert [r[0] for r in df.select(monitor.format_clock(F.col("s"))).collect()] == [
        "0:00", "0:00", "0:00", "0:00", "1:01", "60:00"]


def test_host_severity(spark):
    df = spark.createDataFrame(
        [("a", 79.9, 49.9, 1.49, 1), ("b", 80.0, 10.0, 0.0, 1), ("c", 92.0, 50.0, 6.0, 2), ("d", 1.0, 80.0, 3.0, 2)],
        "host string, mem_pct double, swap_pct double, load1 double, cpus int")
    got = {r.host: (r.severity, r.reasons) for r in monitor.classify_host(df).collect()}
    assert got == {
        "a": ("ok", []), "b": ("warn", ["memory at 80.0%"]),
        "c": ("critical", ["memory at 92.0%", "swap at 50.0%", "load 3.0x per cpu"]),
        "d": ("critical", ["swap at 80.0%", "load 1.5x per cpu"])}


def test_rounding_of_the_binary_value(spark):
    values = [k / 1000 for k in range(-2005, 4000, 5)] + [6.3 / 4, 2.675, 1.005, 0.125, 1e6 + 0.005, 12345.675, 7.0, None, 0.1 + 0.2]
    values += [random.Random(3).uniform(0, 50) for _ in range(500)] + [float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", monitor.round_cents(F.col("x")).alias("r"))
    assert [(r.x, r.r) for r in df.collect()] == [(v, v if v in (None, float("inf")) else round(v, 2)) for v in values]


def test_limits_are_checked(spark):
    empty = spark.createDataFrame([], "id long, book_id long, level string, created_at timestamp_ntz, source string, seen_at timestamp_ntz")
    with pytest.raises(ValueError):
        monitor.recent_events(empty, empty, limit=501)
    with pytest.raises(ValueError):
        monitor.tail_logs(empty, "web", 5)


def test_finalize_without_segments(spark):
    books = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    segs = spark.createDataFrame([(1, "ready"), (2, "ready"), (2, "pending")], "book_id long, status string")
    assert rows(planning.finalize(books, segs)) == [(1, "complete"), (2, "error"), (3, "complete")]


def test_rekey(spark):
    """Only keys under the prefix move, and keep what follows it; a folder whose name goes on is another folder."""
    folders = ["clips/77/", "clips/770/", "clips/78/", "other/clips/77/"]
    inv = spark.createDataFrame([(f"{folder}take-{i}.ogg",) for folder in folders for i in range(4)], "key string")
    for source in folders:
        got = migrate.rekey_prefix(inv, source, "old/now/").collect()
        for r in got:
            inside = r.key.startswith(source)
            assert r.moved == inside
            assert r.new_key == ("old/now/" + r.key[len(source):] if inside else r.key)
        assert sum(r.moved for r in got) == 4


def test_purge_keeps_longer_ids(spark):
    inv = spark.createDataFrame([("audio/1/x",), ("audio/12/x",), ("audio/1",), ("other/1/x",), ("pdfs/1/x",)], "key string")
    ids = spark.createDataFrame([(1,)], "book_id long")
    assert rows(planning.purge_prefixes(inv, ids)) == [("audio/1/x", 1), ("pdfs/1/x", 1)]


def test_copy_refuses_a_filled_target(spark):
    path = scratch_dir(spark, "copy")
    src = spark.createDataFrame([(1, "a\0b")], "id int, t string")
    assert tables.copy_table(src, ["id", "t"], path).first().rows_copied == 1
    assert spark.read.parquet(path).first().t == "ab"
    with pytest.raises(ValueError):
        tables.copy_table(src, ["id", "t"], path)


SEGMENTS = "book_id long, seg_order int, delivered_at int, generation int, text string"


def test_a_book_in_two_deliveries(spark):
    path = scratch_dir(spark, "segments")
    for batch in range(2):
        part = [(1, i, batch, 0, f"{batch}") for i in range(5 * batch, 5 * batch + 5)]
        tables.write_segments(spark.createDataFrame(part, SEGMENTS), path, batch)
    assert [r.seg_order for r in tables.read_segments(spark, path).orderBy("seg_order").collect()] == list(range(10))


def test_a_newer_generation_replaces_a_book(spark):
    path = scratch_dir(spark, "segments")
    first = [(b, i, 0, 0, "old") for b in range(40) for i in range(3)]
    tables.write_segments(spark.createDataFrame(first, SEGMENTS), path, 0)
    tables.compact(spark, path, tables.current_segments)
    again = [(7, 0, 1, 1, "new"), (8, 0, 1, 1, "new"), (9, 1, 1, 0, "late")]
    for _ in range(2):
        tables.write_segments(spark.createDataFrame(again, SEGMENTS), path, 1)
    want = [(b, i, "old") for b, i, *_ in first if b not in (7, 8) and (b, i) != (9, 1)]
    want = sorted(want + [(7, 0, "new"), (8, 0, "new"), (9, 1, "late")])
    assert rows(tables.read_segments(spark, path).select("book_id", "seg_order", "text")) == want
    tables.compact(spark, path, tables.current_segments)
    tables.drop_superseded(spark, path)
    assert rows(tables.read_segments(spark, path).select("book_id", "seg_order", "text")) == want


def test_texts_move_once(spark):
    """Texts are reduced in the stage that joins them to what is current: one exchange, one sort."""
    data = [(1, i % 2, 0, 0, "a") for i in range(4)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        current = tables.current_segments(spark.createDataFrame(data, SEGMENTS))
        plan = current._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" in plan and not re.search("Exchange|Sort ", plan[: plan.index("SortMergeJoin")])
        assert rows(current) == [(1, 0, 0, 0, "a"), (1, 1, 0, 0, "a")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_current_segments_keep_nulls_and_ties(spark):
    data = [(1, None, None, 0, "a"), (1, None, None, 0, "b"), (1, 2, 5, 0, "c"), (1, 2, None, 0, "z"), (2, 0, 1, 0, "old"),
            (2, 1, 1, 1, "new"), (3, 0, 0, 0, None)]
    got = tables.current_segments(spark.createDataFrame(data, SEGMENTS)).collect()
    assert {tuple(r) for r in got} == {data[1], data[2], data[5], data[6]} and len(got) == 4


def test_a_killed_compaction_leaves_the_table(spark):
    path = scratch_dir(spark, "segments")
    data = [(1, i, 0, 0, "kept") for i in range(50)]
    tables.write_segments(spark.createDataFrame(data, SEGMENTS), path, 0)

    def dies(df):
        return tables.current_segments(df).withColumn("text", F.raise_error(F.lit("killed")))

    with pytest.raises(Exception, match="killed"):
        tables.compact(spark, path, dies)
    assert tables.read_segments(spark, path).count() == 50
    tables.compact(spark, path, tables.current_segments)
    assert tables.read_segments(spark, path).count() == 50


def test_an_unreadable_table_is_not_an_empty_one(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables._exists(spark, str(tmp_path)).count()
    assert tables._exists(spark, str(tmp_path / "nowhere")) is None


def test_status_summary_with_a_null_status(spark):
    books = spark.createDataFrame([("error",), (None,)], "status string")
    got = rows(catalog.status_summary(books).filter("n > 0").fillna("null", ["status"]))
    assert got == [("error", 1), ("null", 1), ("total", 2)]


def test_null_keys_spread(spark):
    """Nine of ten rows without a key: their join keys differ."""
    events = spark.range(100).selectExpr("id", "IF(id % 10 = 0, id, NULL) AS book_id", "'info' AS level")
    none = spark.createDataFrame([], "id long, book_id long, segment_id long")
    ids = spark.createDataFrame([(10,)], "book_id long")
    left = catalog.delete_books(events, none, none, events, ids)["pipeline_events"]
    assert left.filter("book_id IS NULL").count() == 91 and left.count() == 100
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(concat(b" in plan
    segs = spark.range(100).selectExpr("id", "id AS book_id", "0 AS seg_order", "'t' AS text", "CAST(NULL AS STRING) AS audio_path",
                                       "'ready' AS status", "1 AS duration")
    files = spark.createDataFrame([("storage/audio/1",)], "key string")
    moved = migrate.remap_ids(events, segs, files, files, 1)["segments"]
    assert moved.filter("audio_path IS NULL").count() == 100
    assert "_path" in moved._jdf.queryExecution().optimizedPlan().toString()
    voices = spark.createDataFrame([("a", "p", "l", "v")], "key string, provider string, label string, voice string")
    books = spark.range(20).selectExpr("id", "CAST(NULL AS STRING) AS tts_narrator", "'' AS tts_instructions")
    assert catalog.resolve_narrator(books, voices, "a").filter("preset = 'a'").count() == 20


def test_worker_rollup_sorts_by_the_short_name(spark):
    items = spark.createDataFrame([("celery@b", "done"), ("a", "done"), ("celery@c", "done")], "worker string, state string")
    assert [r.name for r in monitor.worker_rollup(items).collect()] == ["a", "b", "c"]


def test_equal_times_do_not_flip(spark):
    from corpuskit.streaming import jobs

    beats = spark.createDataFrame([("h", 1, 5.0), ("h", 1, 7.0)], "host string, seen_at int, value double")
    assert {jobs.latest_per_host(beats.orderBy(order)).first().value for order in (F.asc("value"), F.desc("value"))} == {7.0}


@pytest.mark.parametrize("size", [1799, 1800, 1801])
@pytest.mark.parametrize("newline", [False, True])
def test_regions_about_the_cap(spark, size, newline):
    """A region that fits is a chunk as it is, by the short way as by the fold."""
    text = ("word " * 400)[: size - 1] + "."
    text = text.replace(" ", "\n", 1) if newline else text
    got = spark.createDataFrame([(text,)], "t string").select(chunks.pack_chunks(F.col("t")).alias("c")).first().c
    assert all(len(c) <= chunks.CHUNK_CHARS for c in got)
    assert " ".join(got).split() == text.split() and (len(got) == 1) == (size <= chunks.CHUNK_CHARS)


def test_votes_replay(spark):
    schema = "ab_test_id long, user_id long, choice string, created_at int, voted_at int, id long"
    batch = spark.createDataFrame([(1, 1, "A", 5, 5, 1), (1, 1, "B", 9, 9, 2), (1, 2, "A", 6, 6, 3)], schema)
    once = votes.upsert_votes(batch.limit(0), batch)
    assert rows(once.select("user_id", "choice", "created_at")) == [(1, "B", 5), (2, "A", 6)]
    assert rows(votes.upsert_votes(once, batch).select(*once.columns)) == rows(once)


def test_polish_hook_falls_back(spark):
    df = spark.createDataFrame([(1, i, f"chunk {i} of some length") for i in range(9)], "doc_id long, seg_order int, text string")

    def polish(t):
        return t * 6 if int(t.split()[1]) % 3 == 0 else f"ok {t}"

    guarded = corpus.polish_guard(corpus.apply_polish(df, polish))
    assert rows(corpus.fallback_report(guarded)) == [(1, 3, 9)]
    assert {r.seg_order: r.text for r in guarded.collect()}[4] == "ok chunk 4 of some length"

    def broken(t):
        raise RuntimeError("service down")

    assert rows(corpus.fallback_report(corpus.polish_guard(corpus.apply_polish(df, broken)))) == [(1, 9, 9)]
    assert rows(corpus.fallback_report(guarded.limit(0))) == []


def test_one_failing_call_costs_one_chunk(spark):
    texts = [f"chunk number {i} of a book" for i in range(3000)] + ["", "  ", None, "nothing comes back", "no text"]
    df = spark.createDataFrame(list(enumerate(texts)), "seg_order int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")

    def polish(t):
        n = int(t.split()[2]) if t.startswith("chunk") else -1
        if n % 7 == 0:
            raise TimeoutError
        return {"nothing comes back": None, "no text": 5}.get(t, t.upper())

    try:
        got = {r.seg_order: r.cleaned for r in corpus.apply_polish(df, polish, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: t.upper() if t and t.startswith("chunk") and i % 7 else None for i, t in enumerate(texts)}


@pytest.mark.parametrize(("calls", "threads", "least", "most"), [(16, 8, 0.3, 1.5), (4, 1, 0.7, 60)])
def test_calls_overlap(calls, threads, least, most):
    """The call itself waits; measured without Spark's own start."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    started, running, peak = time.monotonic(), [], []

    def call(item):
        running.append(item)
        peak.append(len(running))
        time.sleep(0.2)
        running.remove(item)
        return -item

    read = []
    with ThreadPoolExecutor(threads) as pool:
        source = (read.append(i) or i for i in range(calls))
        for n, result in enumerate(corpus._in_order(pool, call, source, 2 * threads)):
            assert result == -n and len(read) <= n + 2 * threads
    assert least <= time.monotonic() - started < most and max(peak) == threads


@pytest.mark.parametrize("slots", [1, 3, 4096])
def test_sessions_of_one_host_in_slices(spark, slots):
    """All beats are one host's (and one without a name's); sessions cross slices or end at them."""
    rng, t, times = random.Random(slots), 1_000_000, []
    for _ in range(800):
        t += rng.choice([0, 1, 30, 119, 120, 121, 240, 400, 5000])
        times.append(t)
    want = []
    for at in times:
        if want and at - want[-1][1] <= 120:
            want[-1][1:] = [at, want[-1][2] + 1]
        else:
            want.append([at, at, 1])
    beats = spark.createDataFrame([(h, at) for at in times for h in ("a", None)], "host string, at long").select(
        "host", F.timestamp_seconds("at").alias("seen_at"))
    got = monitor.liveness_sessions(beats, slice_slots=slots).select(
        "host", F.unix_seconds(F.col("alive_from").cast("timestamp")).alias("f"),
        F.unix_seconds(F.col("alive_until").cast("timestamp")).alias("u"), "beats").collect()
    expected = [(h, f, last + 120, n) for h in ("a", None) for f, last, n in want]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_chunk_invariants(spark, sf_dir):
    got = QUERIES["prepare_corpus"](spark, sf_dir).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.text) <= chunks.CHUNK_CHARS or " " not in r.text
        assert r.text == r.text.strip() != ""
    for doc in by_doc.values():
        assert sorted(r.seg_order for r in doc) == list(range(len(doc)))


def test_no_shuffle_in_the_corpus_job(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page_count"), "text")
    plan = corpus.chunk_rows(corpus.prepare_corpus(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name, most", [("narrations", 5), ("initial_narrator", 7), ("library_list", 7)])
def test_scans_of_the_narration_family(spark, sf_dir, name, most):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most


def test_scanned_events_prepare_texts_once(spark, sf_dir):
    """The test for scans stays above the exchange that deals the texts, and the chunks are computed once."""
    plan = registry.QUERIES["scanned_events"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):] if "RepartitionByExpression" in plan else plan[plan.index("Repartition"):]
    assert "aggregate(" not in below
    report = corpus.extract_report(registry._prepared(registry.derived(spark, sf_dir)))
    assert plan.count("array_sort(") == report._jdf.queryExecution().optimizedPlan().toString().count("array_sort(")


def test_openings_pass_the_join_without_sorts(spark):
    """Only openings are sorted: segments pass a table of books. Nulls, ties and a hot book included."""
    data = [(1, 3, "c"), (1, 0, "abcdef"), (None, 2, "n"), (None, 1, "m"), (2, None, "x"), (3, None, "y"), (3, 5, "z"), (4, 1, None)]
    segs = spark.createDataFrame(data, "book_id long, seg_order int, text string")
    hot = spark.range(20_000).selectExpr("9L AS book_id", "CAST(id AS INT) AS seg_order", "CAST(id AS STRING) AS text")
    found = catalog.first_segment_excerpt(segs.union(hot), 3)
    got = {r.book_id: r.excerpt for r in found.collect()}
    assert got == {1: "abc", None: "m", 2: None, 3: "z", 4: None, 9: "0"}
    plan = catalog.first_segment_excerpt(segs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan[plan.index("ShuffledHashJoin"):]


def test_takes_pass_the_join_without_sorts(spark):
    segs = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (3, 9), (None, 7)], "id long, book_id long")
    data = [(1, "a", "ready"), (1, "a", "ready"), (2, "a", "ready"), (2, "b", "error"), (3, None, "ready"), (4, "a", "ready"),
            (None, "a", "ready")]
    counts = catalog.alt_ready_counts(segs, spark.createDataFrame(data, "segment_id long, narrator string, status string"))
    assert {tuple(r) for r in counts.collect()} == {(7, "a", 3), (8, None, 1), (9, None, 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_voices_heard_without_arrays_of_takes(spark):
    """Takes are counted, not collected; a segment counts once however many takes it has, also with none."""
    segs = spark.createDataFrame([(1, 7, "ready"), (2, 7, "error"), (3, 8, "ready"), (4, 9, None)], "id long, book_id long, status string")
    data = [(1, "a", "ready"), (1, "b", "ready"), (2, "a", "ready"), (3, None, "ready"), (4, "a", "error")]
    heard = catalog._voices_heard(segs, spark.createDataFrame(data, "segment_id long, narrator string, status string"))
    got = {(r.book_id, r.total, r.base_ready, tuple(sorted((v.narrator, v.n) for v in r.voices or ()))) for r in heard.collect()}
    assert got == {(7, 2, 1, (("a", 2), ("b", 1))), (8, 1, 1, ()), (9, 1, 0, ())}
    plan = heard._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(narrator" not in plan and "ShuffledHashJoin" in plan
