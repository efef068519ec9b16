"""Greedy packing of pieces that are rows, for texts that no row holds.

``functions.chunks.pack_chunks`` folds over one text in one row. Here every piece is a row, and one book may have very
many. Where a chunk that starts at a piece ends depends only on the few pieces after it, so the start that follows each
start is found inside of blocks of consecutive pieces, with the head of the next block laid on. Which starts count
follows from the first one: within a block by stepping, across blocks by pointer doubling over the few pieces at which
a block can be left, in as many rounds as the logarithm of the blocks of the longest book.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import CHUNK_CHARS
from ..session import scratch_dir

#: Pieces of one block; a block also reads ``cap + 1`` pieces of the next one.
BLOCK_PIECES = 8192


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _follow(lengths: np.ndarray, own: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``own`` pieces the start after the chunk that starts there, and where its chain leaves.

    Both are offsets; a chunk has as many pieces as fit ``cap`` with a blank between them, one at least.
    """
    ends = np.cumsum(lengths + 1)
    before = ends - lengths - 1
    after = np.maximum(np.searchsorted(ends, before[:own] + cap + 1, "right"), np.arange(own) + 1)
    leaves = after.copy()
    for i in range(own - 1, -1, -1):
        if leaves[i] < own:
            leaves[i] = leaves[leaves[i]]
    return after, leaves


def _reached(edges: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, at): the pieces that chains from piece 0 meet, by ``edges`` (doc_id, at, to) that jump one block.

    In round k the jumps span 2^k blocks: what is reached grows by one jump from all that is reached so far.
    """
    reached = edges.where("at = 0").select("doc_id", "at").unionByName(
        edges.where("at = 0").select("doc_id", F.col("to").alias("at")))
    jumps, span = edges, 1
    while span < blocks:
        jumps = _written(jumps.alias("a").join(
            jumps.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.to") == F.col("b.at")), "left",
        ).select("a.doc_id", "a.at", F.coalesce("b.to", "a.to").alias("to")), "jumps")
        ahead = reached.join(jumps, ["doc_id", "at"]).select("doc_id", F.col("to").alias("at"))
        reached = _written(reached.unionByName(ahead).distinct(), "reached")
        span *= 2
    return reached


def _greedy(texts: list[str], cap: int) -> Iterator[str]:
    """The chunks of all pieces of a document, one piece after another."""
    part, size = [texts[0]], len(texts[0])
    for text in texts[1:]:
        if size + len(text) + 1 <= cap:
            part.append(text)
            size += len(text) + 1
        else:
            yield " ".join(part)
            part, size = [text], len(text)
    yield " ".join(part)


def _short_packed(rows: DataFrame, cap: int, block_pieces: int) -> DataFrame:
    """(doc_id, pos, text, packed): the chunks of documents with less than a block of pieces, the pieces of others."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(doc: int, pos: list[int], texts: list[str], out: list) -> None:
            if pos[0] == 0 and len(texts) < block_pieces:
                out += [(doc, i, text, True) for i, text in enumerate(_greedy(texts, cap))]
            else:
                out += [(doc, at, text, False) for at, text in zip(pos, texts, strict=True)]

        def frame(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["doc_id", "pos", "text", "packed"])

        key, pos, texts = None, [], []
        for batch in batches:
            out: list = []
            docs, blocks = batch["doc_id"].to_numpy(), batch["block"].to_numpy()
            at, text = batch["pos"].tolist(), batch["text"].tolist()
            edges = np.flatnonzero((np.diff(docs) != 0) | (np.diff(blocks) != 0)) + 1
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), len(docs)]):
                if first == end:
                    continue
                if key != (docs[first], blocks[first]):
                    if texts:
                        packed(int(key[0]), pos, texts, out)
                    key, pos, texts = (docs[first], blocks[first]), [], []
                pos += at[first:end]
                texts += text[first:end]
            yield frame(out)
        if texts:
            out = []
            packed(int(key[0]), pos, texts, out)
            yield frame(out)

    dealt = rows.where("doc_id IS NOT NULL").withColumn("block", F.floor(F.col("pos") / block_pieces))
    dealt = dealt.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "pos")
    return dealt.mapInPandas(pack, "doc_id long, pos long, text string, packed boolean")


def pack_rows(pieces: DataFrame, cap: int = CHUNK_CHARS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(doc_id, pos, piece): the chunks of each document, as ``pack_chunks`` cuts them.

    ``pieces``: doc_id, pos (0, 1, ... without gaps within a document) and text, none longer than ``cap`` if it can
    be cut, as ``split_oversized`` gives them; nulls count as empty. A chunk without text is left out, pieces without
    a doc_id belong to no document. No task holds more than a block of a document's pieces.
    """
    if block_pieces <= cap + 1:
        raise ValueError("a block must have more pieces than a chunk may have")
    rows = pieces.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("long").alias("pos"),
        F.coalesce("text", F.lit("")).alias("text"))
    first = _written(_short_packed(rows, cap, block_pieces), "packed")
    short = first.where("packed").select("doc_id", "pos", F.col("text").alias("piece")).where("piece <> ''")
    long = first.where("NOT packed").select("doc_id", "pos", "text")
    return short if long.isEmpty() else short.unionByName(_pack_long(long, cap, block_pieces))


def _pack_long(rows: DataFrame, cap: int, block_pieces: int) -> DataFrame:
    """(doc_id, pos, piece) of documents of any number of blocks."""
    lengths = rows.select("doc_id", "pos", F.length("text").alias("n"))
    block = F.floor(F.col("pos") / block_pieces)
    own = lengths.withColumn("block", block)
    heads = own.where((F.col("block") > 0) & (F.col("pos") % block_pieces <= cap)).withColumn("block", F.col("block") - 1)

    def follow(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("pos")
        first, n = int(found["block"].iloc[0]) * block_pieces, len(found)
        size = min(n, block_pieces)
        after, leaves = _follow(found["n"].to_numpy(np.int64), size, cap)
        return pd.DataFrame({
            "doc_id": found["doc_id"].iloc[:size], "block": found["block"].iloc[:size], "pos": found["pos"].iloc[:size],
            "after": first + after, "leaves": first + leaves, "ends": n <= block_pieces,
        })

    steps = _written(own.unionByName(heads).groupBy("doc_id", "block").applyInPandas(
        follow, "doc_id long, block long, pos long, after long, leaves long, ends boolean"), "steps")

    # a chain enters a block at piece 0 or where chains leave the block before it
    entries = steps.where("pos = 0").select("doc_id", F.col("pos").alias("at")).unionByName(
        steps.where("NOT ends").select("doc_id", F.col("leaves").alias("at"))).distinct()
    edges = _written(entries.join(
        steps.select("doc_id", F.col("pos").alias("at"), F.when(~F.col("ends"), F.col("leaves")).alias("to")),
        ["doc_id", "at"]), "edges")
    blocks = (steps.agg(F.max("block")).first()[0] or 0) + 1
    starts = _reached(edges.where("to IS NOT NULL"), blocks).unionByName(
        edges.where("at = 0").select("doc_id", "at")).distinct().select(
            "doc_id", F.floor(F.col("at") / block_pieces).alias("block"), "at")

    def number(found: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("pos")
        first, is_start = int(found["block"].iloc[0]) * block_pieces, np.zeros(len(found), np.int64)
        after = found["after"].to_numpy() - first
        for at in entered["at"]:
            at -= first
            while at < len(found):
                is_start[at] = 1
                at = after[at]
        return pd.DataFrame({
            "doc_id": found["doc_id"], "block": found["block"], "pos": found["pos"], "nth": np.cumsum(is_start)})

    within = _written(steps.groupBy("doc_id", "block").cogroup(starts.groupBy("doc_id", "block")).applyInPandas(
        number, "doc_id long, block long, pos long, nth long"), "within")
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = within.groupBy("doc_id", "block").agg(F.max("nth").alias("n")).select(
        "doc_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = within.join(offsets, ["doc_id", "block"]).select(
        "doc_id", F.col("pos").alias("at"), (F.col("before") + F.col("nth") - 1).alias("chunk"))
    texts = rows.withColumnRenamed("pos", "at").join(numbered, ["doc_id", "at"])
    chunks = texts.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return chunks.select(
        "doc_id", F.col("chunk").alias("pos"), F.array_join(F.col("parts.text"), " ").alias("piece")).where("piece <> ''")
