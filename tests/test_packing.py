"""Chunks of books whose sentences are rows, against the greedy rule in one loop."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import packing


def greedy(texts, cap):
    out, current = [], ""
    for n, t in enumerate(texts):
        if n and len(current) + 1 + len(t) > cap:
            out.append(current)
            current = t
        else:
            current = t if not n else f"{current} {t}"
    return [*out, current]


@pytest.mark.parametrize("seed", range(3))
def test_random_books(spark, seed):
    rng = random.Random(seed)
    books = {}
    for doc in range(30):
        lengths = rng.choice([(1, 1), (1, 5), (3, 12), (20, 40), (10, 45)])
        books[doc] = ["x" * rng.randint(*lengths) for _ in range(rng.choice([1, 2, 60, 500, 1500]))]
    rows = [(d, i, t, "extra") for d, texts in books.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, text string, block string").repartition(4)
    got = {}
    for r in packing.pack_rows(df, cap=40, block_pieces=64).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.piece
    assert {d: [c[i] for i in range(len(c))] for d, c in got.items()} == {d: greedy(t, 40) for d, t in books.items()}


def test_one_book_of_a_million_sentences(spark):
    size = (F.col("id") * 7919 % 97 + F.col("id") % 13 * 11 + 1).cast("int")
    book = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.repeat(F.lit("s"), size).alias("text"))
    got = packing.pack_rows(book).agg(
        F.count("*").alias("n"), F.max("pos").alias("last"), F.sum(F.xxhash64("pos", F.length("piece")) % 1000003).alias("sum")).first()
    want, current = [], 0
    for i in range(1_000_000):
        n = i * 7919 % 97 + i % 13 * 11 + 1
        if i and current + 1 + n > 1800:
            want.append(current)
            current = n
        else:
            current = current + 1 + n if i else n
    want.append(current)
    expected = spark.createDataFrame(list(enumerate(want)), "pos long, n int").agg(
        F.sum(F.xxhash64("pos", "n") % 1000003)).first()[0]
    assert (got.n, got.last, got["sum"]) == (len(want), len(want) - 1, expected)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    written = []
    keep = packing._written
    monkeypatch.setattr(packing, "_written", lambda df, name: (written.append(name), keep(df, name))[1])
    book = spark.range(64 * 40).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.lit("word").alias("text"))
    packing.pack_rows(book, cap=40, block_pieces=64)
    assert written.count("jumps") == 6


def test_odd_rows(spark):
    schema = "doc_id long, pos long, text string"
    assert packing.pack_rows(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, ""), (2, 0, None), (3, 0, "y" * 5000), (3, 1, "z"), (3, 2, "y" * 5000)]
    got = packing.pack_rows(spark.createDataFrame(rows, schema)).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, len(r.piece)) for r in got] == [(3, 0, 5000), (3, 1, 1), (3, 2, 5000)]


def test_short_documents_are_packed_as_they_come(spark):
    """Documents of less than a block take one exchange and no group of their own; one of a block or more takes all steps."""
    rng = random.Random(5)
    sizes = {d: rng.choice([1, 2, 5, 39, 40, 41, 90]) for d in range(120)}
    rows = [(d, i, rng.choice([None, "", "x" * rng.randint(1, 30)])) for d, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    pieces = spark.createDataFrame(rows, "doc_id long, pos int, text string").repartition(7)
    done = packing._short_packed(pieces.fillna(""), 38, 40)
    assert {r.doc_id for r in done.where("NOT packed").select("doc_id").distinct().collect()} == {
        d for d, n in sizes.items() if n >= 40}
    got = sorted(tuple(r) for r in packing.pack_rows(pieces, 38, 40).collect())
    want = []
    for d in sizes:
        texts = [t or "" for _, _, t in sorted((r for r in rows if r[0] == d), key=lambda r: r[1])]
        chunks = []
        for t in texts:
            if chunks and len(chunks[-1]) + 1 + len(t) <= 38:
                chunks[-1] += " " + t
            else:
                chunks.append(t)
        want += [(d, i, c) for i, c in enumerate(chunks) if c]
    assert got == sorted(want)
    only_short = packing.pack_rows(pieces.where(F.col("doc_id").isin([d for d, n in sizes.items() if n < 40])), 38, 40)
    plan = only_short._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
