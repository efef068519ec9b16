"""Sharding by histogram sort: probes are refined until exact counts place every splitter, then one exchange.

Rows are sorted by the hash of their text, then by id, so that equal texts are neighbours. The key space is cut into
cells by leading bits. Every round counts the exact rows and bytes of the cells that a splitter falls into or that
hold too many rows, eight bits deeper; the rows of a cell that has become small are looked at one by one.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import NO_ID, stage, table

#: A splitter may be off by this share of a shard before it is placed inside a group of equal texts.
TOLERANCE = 0.001
#: Rows of a cell that the driver looks at one by one.
LOOK = 1_000
STEP = 8
BITS = 128
SIGN = -(1 << 63)


def _prefix(bits: int):
    """The leading `bits` (1 to 128) of hash and id, with the sign flipped so that prefixes sort as the numbers do."""
    high, low = F.col("hash").bitwiseXOR(F.lit(SIGN)), F.col("id").bitwiseXOR(F.lit(SIGN))
    if bits <= 64:
        return F.struct(F.shiftrightunsigned(high, 64 - bits).alias("a"), F.lit(0).cast("long").alias("b"))
    return F.struct(high.alias("a"), F.shiftrightunsigned(low, 128 - bits).alias("b"))


def _start(a: int, b: int, bits: int) -> int:
    """The least 128-bit key with this prefix."""
    mask = (1 << 64) - 1
    a, b = a & mask, b & mask
    return (a << (128 - bits)) if bits <= 64 else (a << 64) | (b << (128 - bits))


def _key(hashed: int, row_id: int) -> int:
    return ((hashed - SIGN) << 64) | (row_id - SIGN)


def _count(keys: DataFrame, bits: int, inside: list[tuple[int, int]] | None) -> list[tuple[int, int, int, int]]:
    """(start, end, rows, bytes) of the cells of `bits` leading bits, of those only that lie in `inside` cells."""
    spark = keys.sparkSession
    if inside is not None:
        chosen = spark.createDataFrame(inside, "pa long, pb long")
        parent = _prefix(bits - STEP)
        keys = keys.withColumns({"ka": parent["a"], "kb": parent["b"]})
        keys = keys.join(F.broadcast(chosen), (F.col("ka") == F.col("pa")) & (F.col("kb") == F.col("pb")), "left_semi")
    cells = keys.groupBy(_prefix(bits).alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
    width = 1 << (BITS - bits)
    found = [(_start(r.p.a, r.p.b, bits), r.rows, r["size"]) for r in cells.collect()]
    return sorted((s, s + width, n, size) for s, n, size in found)


def _signed(prefix: int, bits: int) -> tuple[int, int]:
    """The prefix of a cell as the two longs that `_prefix` gives."""
    wrap = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    if bits <= 64:
        return wrap(prefix >> (128 - bits)), 0
    return wrap(prefix >> 64), wrap((prefix & ((1 << 64) - 1)) >> (128 - bits))


def _between(keys: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of a cell."""
    def at_least(key: int):
        hashed, row_id = (key >> 64) + SIGN, (key & ((1 << 64) - 1)) + SIGN
        return (F.col("hash") > hashed) | ((F.col("hash") == hashed) & (F.col("id") >= row_id))

    inside = at_least(start)
    return keys.where(inside & ~at_least(end) if end < 1 << 128 else inside)


def place_splitters(keys: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
    """`shards` - 1 splitter keys and the final cells (start, rows), each cell within one shard.

    `keys` has hash, id and size. Driver memory is bounded by 256 times the shards and 4,096 cells.
    """
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).head()
    if not rows:
        return [], []
    most = max(20_000, rows // 4096)
    targets = [total * i / shards for i in range(1, shards)]
    slack = TOLERANCE * total / shards
    bits = STEP
    cells = _count(keys, bits, None)
    splitters: dict[int, int] = {}
    while True:
        ends = np.cumsum([c[3] for c in cells])
        open_cells, deeper = set(), set()
        for i, target in enumerate(targets):
            if i in splitters:
                continue
            at = min(int(np.searchsorted(ends, target)), len(cells) - 1)
            before = int(ends[at - 1]) if at else 0
            if abs(before - target) <= slack:
                splitters[i] = cells[at][0]
            elif abs(int(ends[at]) - target) <= slack:
                splitters[i] = cells[at][1]
            elif cells[at][2] <= LOOK or cells[at][1] - cells[at][0] == 1:
                open_cells.add(at)
            else:
                deeper.add(at)
        width = 1 << (BITS - bits)
        large = {i for i, c in enumerate(cells) if c[2] > most and c[1] - c[0] == width and width > 1}
        deeper = {i for i in deeper | large if cells[i][1] - cells[i][0] == width and width > 1}
        if not deeper:
            break
        bits += STEP
        finer = _count(keys, bits, [_signed(cells[i][0], bits - STEP) for i in sorted(deeper)])
        cells = sorted([c for i, c in enumerate(cells) if i not in deeper] + finer)
    for at in sorted(open_cells, reverse=True):
        start, end, _, _ = cells[at]
        inside = sorted((_key(r["hash"], r["id"]), r["size"]) for r in _between(keys, start, end).collect())
        before = int(ends[at - 1]) if at else 0
        sums = before + np.cumsum([0] + [size for _, size in inside])
        edges = [k for k, _ in inside] + [end]
        first = [j == 0 or edges[j] >> 64 != edges[j - 1] >> 64 for j in range(len(edges))]
        for i, target in enumerate(targets):
            if i not in splitters and before <= target <= sums[-1]:
                whole = min((j for j in range(len(edges)) if first[j]), key=lambda j: abs(sums[j] - target))
                best = min(range(len(edges)), key=lambda j: abs(sums[j] - target))
                splitters[i] = edges[whole if abs(sums[whole] - target) <= slack else best]
        cuts = sorted({s for s in splitters.values() if start < s < end})
        parts = []
        for a, b in zip([start, *cuts], [*cuts, end], strict=True):
            mine = [size for k, size in inside if a <= k < b]
            parts.append((a, b, len(mine), sum(mine)))
        cells[at : at + 1] = parts
    return [splitters[i] for i in range(len(targets))], [(c[0], c[2]) for c in cells if c[2]]


def _bytes16(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """128-bit keys as byte strings that sort alike."""
    return np.ascontiguousarray(np.stack([high, low], axis=1).astype(">u8")).view("S16").ravel()


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The sizes (UTF-8 bytes plus 1; null text counts as empty) of the shards differ by TOLERANCE or one row. Equal
    texts share a shard unless that would cost more than TOLERANCE. Slots follow the order of hash and id, without
    gaps. Rows without an id come first among equal texts, each with a key of its own, so that very many of them are
    cut like any others. Rows equal in text and a real id may swap slots; an unbounded number of copies of one row
    would meet in one task. Very long texts count with their size, a shard may differ by one of them. An empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    salt = F.lit(NO_ID) + F.monotonically_increasing_id()  # written with the keys, so it stays what it is
    keys = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), salt).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
        ),
        "shard-keys",
    )
    splitters, cells = place_splitters(keys, shards)
    starts = [s for s, _ in cells]
    mask = (1 << 64) - 1
    edges = _bytes16(np.array([s >> 64 for s in starts], np.uint64), np.array([s & mask for s in starts], np.uint64))
    shard_of = [bisect_right(splitters, s) for s in starts]
    offsets, filled = [], [0] * shards
    for shard, (_, rows) in zip(shard_of, cells, strict=True):
        offsets.append(filled[shard])
        filled[shard] += rows
    numbers = np.array(shard_of, np.int32), np.array(offsets, np.int64)

    @F.pandas_udf("struct<cell int, shard int, offset long>")
    def locate(hashed: pd.Series, row_id: pd.Series) -> pd.DataFrame:
        sign = np.uint64(1 << 63)
        key = _bytes16(hashed.to_numpy(np.int64).view(np.uint64) ^ sign, row_id.to_numpy(np.int64).view(np.uint64) ^ sign)
        cell = np.searchsorted(edges, key, side="right") - 1
        return pd.DataFrame({"cell": cell.astype(np.int32), "shard": numbers[0][cell], "offset": numbers[1][cell]})

    placed = keys.withColumn("at", locate("hash", "id"))
    order = Window.partitionBy("at.cell").orderBy("hash", "id", "size")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("at.shard").alias("shard"),
        (F.col("at.offset") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))
