"""Substring search of very many books, and for very many needles at once, by an index of trigrams.

A posting list names the fields (title or author) that hold a trigram; it is cut into blocks by a hash of the book, so
that the list of a trigram in every title is many rows. A needle asks for the list of its rarest trigram, or for several
that are intersected, and what is found is verified against the text. Which lists are read changes the number of
candidates, never the result.

``match_needles`` is for as many needles as there are books, where the candidates of an index are far more than what is
found. It has no candidates: a field is cut into windows as long as the needles, which are joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..session import scratch_dir

#: Fields of one block of a posting list, on average.
BLOCK_FIELDS = 4096
#: Lists that are read for one needle. Intersecting several spares verifications, but all of their entries are shuffled,
#: which on titles costs far more than it spares.
LISTS = 1
#: Needles of up to so many characters have windows of their own length, longer ones of the power of two below.
EXACT = 8
#: Bits by which windows that no needle begins with are dropped before the join: at most a word of 64 each a row.
FILTER_BITS = 1 << 25
FIELDS = ("title", "author")


def grams(text: Column, n: int = 3) -> Column:
    """The distinct substrings of ``n`` characters; none for shorter texts and nulls."""
    every = let(text, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n))))
    return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _fields(books: DataFrame) -> DataFrame:
    """(id, field, text): a row for each title and each author, in lower case; nulls hold nothing."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in FIELDS)))
    return books.select("id", each.alias("f")).select("id", "f.*").where(F.col("text").isNotNull())


def trigram_index(books: DataFrame, block_fields: int = BLOCK_FIELDS) -> DataFrame:
    """(gram, blocks, block, fields): the posting lists of titles and authors.

    A list has ``blocks`` blocks, by its length; a field lies in the block of its book's hash. Lists are counted after
    partial counts, so a gram of every title is never sorted or gathered whole.
    """
    postings = _fields(books).select(F.explode(grams(F.col("text"))).alias("gram"), F.struct("id", "field").alias("at"))
    sizes = postings.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / block_fields).cast("int").alias("blocks"))
    dealt = postings.join(sizes, "gram").withColumn("block", F.pmod(F.xxhash64("at.id"), "blocks").cast("int"))
    return dealt.groupBy("gram", "blocks", "block").agg(F.collect_list("at").alias("fields"))


def write_index(books: DataFrame, path: str, block_fields: int = BLOCK_FIELDS) -> None:
    """The index as files in order of the grams, so that a search for literal grams reads few row groups."""
    index = trigram_index(books, block_fields)
    index.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(path)


def candidates(index: DataFrame, needles: DataFrame, lists: int = LISTS) -> DataFrame:
    """(needle, id, field): fields in the ``lists`` shortest lists of each needle of three characters or more.

    A needle with a gram that no list has finds nothing.
    """
    asked = needles.select("needle").distinct().withColumn("gram", F.explode(grams(F.col("needle"))))
    # every block of a list has about as many fields, so the blocks and then the fields tell how rare a gram is
    rarity = index.groupBy("gram").agg(F.sum(F.size("fields")).alias("n"), F.first("blocks").alias("blocks"))
    known = asked.join(rarity, "gram", "left").groupBy("needle").agg(
        F.sort_array(F.collect_list(F.struct("n", "gram", "blocks"))).alias("lists"), F.count_if(F.col("n").isNull()).alias("unknown")
    ).where("unknown = 0").withColumn("lists", F.slice("lists", 1, lists))
    wanted = known.select("needle", F.size("lists").alias("wanted"), F.explode("lists").alias("l")).select(
        "needle", "wanted", "l.gram", F.explode(F.sequence(F.lit(0), F.col("l.blocks") - 1)).alias("block"))
    found = wanted.join(index.select("gram", "block", "fields"), ["gram", "block"])
    hits = found.select("needle", "wanted", F.explode("fields").alias("at"))
    if lists == 1:
        return hits.select("needle", "at.*")
    return hits.groupBy("needle", "wanted", "at").agg(F.count(F.lit(1)).alias("n")).where("n = wanted").select("needle", "at.*")


def search_needles(books: DataFrame, index: DataFrame, needles: DataFrame, lists: int = LISTS) -> DataFrame:
    """(query, id): the books whose title or author holds each query, as ``search_books`` finds them one by one.

    ``needles``: a column ``query``; it is trimmed and lowered, and equal ones are searched once. Needles of one or two
    characters are too short for the index: the fields are scanned for substrings of that length, joined by equality.
    Blank and null queries filter nothing and have no rows here.
    """
    asked = needles.select("query").distinct().withColumn("needle", F.lower(F.trim("query"))).where("needle <> ''")
    distinct = asked.select("needle").distinct()
    fields = _fields(books)
    long = candidates(index, distinct.where(F.length("needle") >= 3), lists).join(fields, ["id", "field"]).where(
        F.col("text").contains(F.col("needle"))
    ).select("needle", "id")
    parts = F.explode(F.array_union(grams(F.col("text"), 1), grams(F.col("text"), 2)))
    short = fields.select("id", parts.alias("needle")).join(distinct.where(F.length("needle") < 3), "needle").select("needle", "id")
    return asked.join(long.unionByName(short).distinct(), "needle").select("query", "id")


def _filter_place(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key among FILTER_BITS bits."""
    place = F.xxhash64(key).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    return F.shiftright(place, 6), F.call_function(
        "shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def match_needles(books: DataFrame, needles: DataFrame) -> DataFrame:
    """(query, id): what ``search_needles`` finds, without an index, for very many needles.

    A needle is looked up by its first characters: all of them up to EXACT, else the power of two below its length.
    Every window of a field that may begin a needle carries the characters after its key that decide it, so nothing is
    read a second time. The work follows the fields times the key lengths in use, few at any number of needles, and
    what is shuffled follows what is found.
    """
    size = F.length("needle")
    power = F.call_function("shiftleft", F.lit(1), F.length(F.bin(size.cast("long"))) - 1)
    path = scratch_dir(needles.sparkSession, "needles")
    asked = needles.select("query").distinct().withColumn("needle", F.lower(F.trim("query"))).where("needle <> ''")
    asked = asked.withColumn("n", F.when(size <= EXACT, size).otherwise(power)).select(
        "query", "n", F.expr("left(needle, n)").alias("key"), F.expr("substr(needle, n + 1)").alias("rest"))
    asked.write.parquet(path)  # so that the join knows how small it is
    asked = needles.sparkSession.read.schema(asked.schema).parquet(path)
    word, bit = _filter_place(F.col("key"))
    known = asked.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))

    lengths = [r.n for r in asked.select("n").distinct().collect()]
    if not lengths:
        return asked.select("query").join(books.select("id"), F.lit(False))
    # start by start and length by length, in steps that are compiled: arrays of windows cost several times as much
    starts = _fields(books).where("text <> ''").withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text"))))
    cut = starts.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where("at + n <= length(text) + 1")
    cut = cut.withColumn("key", F.expr("substr(text, at, n)")).withColumns({"word": word, "bit": bit})
    begun = cut.join(F.broadcast(known), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    # a key of EXACT characters or more is that of all needles shorter than twice its length
    tail = F.when(F.col("n") >= EXACT, F.expr("substr(text, at + n, n - 1)")).otherwise("")
    begun = begun.select("id", "key", tail.alias("tail"))
    found = begun.join(asked, "key").where(F.startswith("tail", F.col("rest")))
    return found.select("query", "id").distinct()
