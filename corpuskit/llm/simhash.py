"""SimHash near-dedup through an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight positional bytes. Of
five shared bytes, three fall into the same half of the fingerprint, so every such pair meets in a posting list of
the index by three of the four byte positions of a half. In a list, shared positional bytes are tallied for the pairs,
those with fewer than five are dropped and the rest are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import released, shuffle_parts, stage, table, text_tag
from corpuskit.llm.components import connected_components

MAX_BITS = 3
MIN_BYTES = 5
#: Posting lists with more fingerprints are refined by two further byte positions.
LONG_LIST = 20_000
#: Pairs of up to this many neighbours in a sorted list are compared at once, longer lists by search from members.
SHORT_LIST = 8
PIECE = 100_000
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def _hashes(text: str | None) -> list[int]:
    """Unsigned XXH64 (seed 42) of the 3-word shingles; of the whole word sequence if it is shorter."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white-space bytes only
    if not words:
        return []
    if len(words) < 3:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-3] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[2:].tolist(), strict=True)]


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, the highest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned number; zero without words."""
    hashes = np.array(_hashes(text), np.uint64)
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(2 * _set_bits(hashes) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tag, fp (the fingerprint's bits as a long) for every row; null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([simhash(t) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tag": batch["tag"], "fp": fps.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_tag().alias("tag"))
    return rows.mapInPandas(released(run), "doc_id long, tag long, fp long")


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """The number of zero bytes of each XOR: the tally of positional bytes that a pair shares."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((x & low) + low) | x | low))


def _near(x: np.ndarray) -> np.ndarray:
    """Count filter, then the verification of what passes it."""
    kept = _shared_bytes(x) >= MIN_BYTES
    kept[kept] = np.bitwise_count(x[kept]) <= MAX_BITS
    return kept


def _search(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the members of each component of a list: a search from member to member, each taken once."""
    rest, found = members, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _near(rest ^ at)
            if near.any():
                hit = rest[near]
                found.append((np.full(len(hit), at), hit))
                frontier.extend(hit)
                rest = rest[~near]
    return found


def _list_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the lists of equal, adjacent keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    short = np.repeat(sizes <= SHORT_LIST, sizes)
    found = []
    for step in range(1, SHORT_LIST):
        same = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:]) if step < len(keys) else starts[:0]
        hit = same[_near(fps[same] ^ fps[same + step])]
        found.append((fps[hit], fps[hit + step]))
    for at, n in zip(starts[sizes > SHORT_LIST].tolist(), sizes[sizes > SHORT_LIST].tolist(), strict=True):
        found += _search(fps[at : at + n])
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, fp) rows in, links out; a list that goes on in the next batch is held until it is whole."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate((keys, batch["key"].to_numpy(np.int64)))
        fps = np.concatenate((fps, batch["fp"].to_numpy(np.int64).view(np.uint64)))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole:
            u, v = _list_links(keys[:whole], fps[:whole])
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        u, v = _list_links(keys, fps)
        yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def _key(positions: tuple[int, ...]):
    """The bytes at `positions`, with the positions themselves in a byte on top (unique below 56 lists)."""
    value = F.lit(0).cast("long")
    for p in positions:
        value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255)))
    return value


def near_links(prints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` at three or fewer differing bits, enough to connect all of them.

    A list longer than `long_list` is replaced by the ten lists of its triple and two of the five other positions:
    the count filter guarantees five shared bytes, so no link is lost.
    """
    spark = prints.sparkSession
    parts = shuffle_parts(spark)
    tagged = [F.shiftleft(F.lit(i).cast("long"), 40).bitwiseOR(_key(t)) for i, t in enumerate(TRIPLES)]
    index = prints.select("fp", F.explode(F.array(*tagged)).alias("key"))
    long = stage(index.groupBy("key").count().where(F.col("count") > long_list).select(F.col("key").alias("hot")), "lists")
    index = index.join(long, F.col("key") == F.col("hot"), "left")
    deeper = []
    for i, t in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in t]
        for j, pair in enumerate(combinations(rest, 2)):
            tag = F.shiftleft(F.lit(8 + 10 * i + j).cast("long"), 40)
            deeper.append(F.when(F.shiftright("key", 40) == i, tag.bitwiseOR(_key((*t, *pair)))))
    deeper = F.filter(F.array(*deeper), lambda k: k.isNotNull())
    keys = F.when(F.col("hot").isNull(), F.array("key")).otherwise(deeper)
    lists = index.select("fp", F.explode(keys).alias("key"))
    return lists.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInPandas(released(_links), "u long, v long")


def components(prints: DataFrame) -> DataFrame:
    """fp, root: the component of every distinct fingerprint, named by its least fingerprint. Equal fingerprints are
    one node, so copies make no links."""
    nodes = stage(prints.select("fp").distinct(), "nodes")
    roots = connected_components(near_links(nodes))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (hex), component_id.

    Rows without words share fingerprint zero, which links like any other. component_id is the smallest doc_id
    that can be reached; rows without an id join components but cannot name one, so a component of such rows only
    has a null id. Repeated rows give repeated results, an empty table none, other columns are ignored.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    known = stage(components(prints), "components")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumnRenamed("fp", "l")
    named = known.join(least, F.col("fp") == F.col("l")).groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(named, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component, with its own columns: that of the least id, rows without an id last, and
    of the least hash of the text among equal ids. Of fully repeated rows one stays."""
    prints = stage(fingerprints(docs), "fingerprints")
    known = stage(components(prints), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first")
    least = prints.groupBy("fp").agg(first).withColumnRenamed("fp", "l")
    kept = known.join(least, F.col("fp") == F.col("l")).groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("k_id"), F.col("first.tag").alias("k_tag"))
    tagged = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("own_id"), text_tag().alias("own_tag"))
    same = F.col("own_id").eqNullSafe(F.col("k_id")) & (F.col("own_tag") == F.col("k_tag"))
    kept = tagged.join(kept.distinct(), same, "left_semi").dropDuplicates(["own_id", "own_tag"])
    return kept.select("own.*")


def op9_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
