"""Search by trigrams against ``contains``, and how many candidates it reads."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import catalog, search

SCHEMA = "id long, title string, author string, genre string"


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcÉ %_") for _ in range(rng.randint(0, 12)))
    rows = [(i, word(), rng.choice([None, "", word()]), None) for i in range(n)]
    return spark.createDataFrame(rows + [rows[0][:1] + rows[0][1:]], SCHEMA).withColumn("needle", F.lit("clash"))


@pytest.mark.parametrize("block,lists", [(1, 1), (5, 3), (4096, 2)])
def test_as_one_by_one(spark, block, lists):
    books = table(spark)
    queries = ["abc", " ABC ", "a", "bé", "é", "%", "a_b", "abca", "bcabc", "zzz", "aaaa", "abc zzz", "  ", "", None, "É b", "abc"]
    needles = spark.createDataFrame([(q, 1) for q in queries], "query string, id int")
    index = search.trigram_index(books, block)
    got = {}
    for r in search.search_needles(books, index, needles, lists).collect():
        got.setdefault(r.query, []).append(r.id)
    for q in filter(None, set(queries)):
        want = {r.id for r in catalog.search_books(books, query=q).collect()} if q.strip() else set()
        assert sorted(got.get(q, [])) == sorted(want), q
    assert None not in got


def test_blocks_hold_every_posting_once(spark):
    books = spark.range(3000).select("id", F.concat(F.lit("Same "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("author"))
    index = search.trigram_index(books, 100)
    same = index.where("gram = 'sam'").collect()
    assert len(same) == 30 and {r.blocks for r in same} == {30} and sum(len(r.fields) for r in same) == 3000
    assert max(len(r.fields) for r in same) < 200


def test_few_candidates(spark, sf_dir):
    """A name that few books have is looked up among a handful of fields, though its prefix stands in every author; a
    needle whose grams all stand in every author, as zeros here, is verified in all of them."""
    books = spark.range(20000).select(
        "id", F.concat(F.lit("Book "), F.col("id").cast("string")).alias("title"),
        F.format_string("Customer#%09d", F.col("id") * 7919 % 2000).alias("author"))
    needles = spark.range(50, 2000, 50).select(F.format_string("customer#%09d", "id").alias("needle"))
    index = search.trigram_index(books)
    read, read_one = search.candidates(index, needles, 3).count(), search.candidates(index, needles).count()
    found = search.search_needles(books, index, needles.withColumnRenamed("needle", "query")).count()
    assert found == 39 * 10 and read < 3 * found and read_one < 39 * 40000 / 50
    zeros = spark.createDataFrame([("customer#000000000",)], "needle string")
    assert search.candidates(index, zeros).count() == 20000
    assert search.search_needles(books, index, zeros.withColumnRenamed("needle", "query")).count() == 10


def test_literal_grams_are_pushed_down(spark, tmp_path):
    search.write_index(table(spark), str(tmp_path / "index"))
    plan = spark.read.parquet(str(tmp_path / "index")).where(F.col("gram").isin("abc", "bca"))._jdf.queryExecution().toString()
    assert "In(gram, [abc,bca])" in plan


def test_empty_tables(spark):
    books, none = table(spark), spark.createDataFrame([], SCHEMA)
    needles = spark.createDataFrame([("abc",), ("a",)], "query string")
    assert search.search_needles(none, search.trigram_index(none), needles).count() == 0
    assert search.search_needles(books, search.trigram_index(books), needles.limit(0)).count() == 0


def test_match_needles_as_one_by_one(spark):
    """Also of lengths at and around the window lengths, and needles that only begin alike."""
    long = "The Whole History of É Things and of %s in Sixty Volumes"
    books = table(spark).unionByName(spark.createDataFrame(
        [(1000 + i, long % c, c * 40, None, "x") for i, c in enumerate(("ab", "É", "aa"))], table(spark).schema))
    text = (long % "ab").lower()
    queries = ["abc", " ABC ", "a", "bé", "é", "%", "a_b", "abca", "bcabc", "zzz", "aaaa", "abc zzz", "  ", "", None, "É b",
               *(text[3 : 3 + n] for n in (7, 8, 9, 15, 16, 17, 31, 32, 33, 50)), text, text + "x", "a" * 64, "a" * 81]
    needles = spark.createDataFrame([(q, 1) for q in queries], "query string, id int")
    got = {}
    for r in search.match_needles(books, needles).collect():
        got.setdefault(r.query, []).append(r.id)
    for q in filter(None, set(queries)):
        want = {r.id for r in catalog.search_books(books, query=q).collect()} if q.strip() else set()
        assert sorted(got.get(q, [])) == sorted(want), q
    assert None not in got and search.match_needles(books, needles.limit(0)).count() == 0


def test_match_needles_without_candidates(spark):
    """The index verifies many fields for each that it finds; here what meets the needles is what is found."""
    books = spark.range(20000).select(
        "id", F.lit(None).cast("string").alias("title"), F.format_string("Customer#%09d", "id").alias("author"))
    needles = spark.range(11111, 20000, 10).select(F.format_string("%06d", "id").alias("query"))
    found = search.match_needles(books, needles)
    rows = found.collect()
    verified = search.candidates(search.trigram_index(books), needles.withColumnRenamed("query", "needle")).count()
    assert len(rows) == needles.count() and verified > 10 * len(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and plan.count("Join") == 2
