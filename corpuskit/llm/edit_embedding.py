"""Document fingerprints by a randomised edit embedding.

All documents share one random walk: at step j the walk stands at a character, gives it out, and moves on or stays by
a random bit for (j, character). Texts at a small edit distance give out strings at a small Hamming distance, since
their walks meet again after an edit. A fingerprint samples SLOTS steps of the whole walk, the same steps for walks of about
the same length, and keeps a byte for each. Walks of many documents advance together, one lane each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import NO_ID, released, shuffle_parts, stage, table

SLOTS = 256
#: Lanes that walk together, steps between looks at finished lanes, characters of texts held at once.
LANES, STRIDE, BATCH_CHARS = 4096, 64, 6_000_000
#: Bands of BAND slots for candidates; documents are near from LIKENESS on.
BAND, LIKENESS = 8, 0.8
PERIOD = 1 << 16
END = 31  # the class of the end of a text, at which every walk stays


def _draws() -> np.ndarray:
    """For each step (modulo PERIOD) a random bit for each of 31 character classes; the bit of END is 0."""
    return np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 31, PERIOD, dtype=np.int64)


DRAWS = _draws()


def _codes(text: str) -> np.ndarray:
    """Characters as bytes whose last five bits, the class, are never END."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = (points * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return ((mixed % 31) | ((mixed >> 5) % 8 << 5)).astype(np.uint8)


def _priority(steps: np.ndarray) -> np.ndarray:
    """A random number for each step, the same everywhere."""
    with np.errstate(over="ignore"):
        x = (steps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def _records(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps below `length` that are the least of their slot so far, and their slots, in order of steps."""
    found = []
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, length, PERIOD):
        steps = np.arange(at, min(at + PERIOD, length))
        value = _priority(steps)
        slot = (value % np.uint64(SLOTS)).astype(np.int64)
        for k in np.flatnonzero(value < least[slot]).tolist():
            if value[k] < least[slot[k]]:
                least[slot[k]] = value[k]
                found.append((at + k, slot[k]))
    steps, slots = zip(*found) if found else ((), ())
    return np.array(steps, np.int64), np.array(slots, np.int64)


def _room(n: int) -> int:
    """Steps that are kept room for, for a text of n characters: a walk takes about two for each, hardly ever more
    than three."""
    return 3 * n + STRIDE


def walk(texts: list[np.ndarray]) -> list[np.ndarray]:
    """What the walk over each text gives out until it has left the last character."""
    sizes = np.array([len(t) for t in texts], np.int64)
    steps = _room(sizes)
    data = np.concatenate([part for t in texts for part in (t, np.array([END], np.uint8))])
    starts, out_starts = np.cumsum(sizes + 1) - sizes - 1, np.cumsum(steps + STRIDE) - steps - STRIDE
    out = np.full(int((steps + STRIDE).sum()), END, np.uint8)
    late: dict[int, np.ndarray] = {}
    queue = np.argsort(-sizes, kind="stable")
    queue = queue[sizes[queue] > 0]
    lanes = queue[:LANES]
    rest = queue[LANES:]
    at, step, put = starts[lanes], np.zeros(len(lanes), np.int64), out_starts[lanes]
    last = out_starts[lanes] + steps[lanes]
    while len(lanes):
        for _ in range(STRIDE):
            given = data[at]
            out[put] = given
            at = at + ((DRAWS[step & (PERIOD - 1)] >> (given & 31)) & 1)
            step = step + 1
            put = put + 1
        done = put >= last
        ended = data[at] == END
        for k in np.flatnonzero(done & ~ended).tolist():
            late[int(lanes[k])] = _to_end(data, int(at[k]), int(step[k]))
        done |= ended
        if done.any():
            free = np.flatnonzero(done)
            new, rest = rest[: len(free)], rest[len(free) :]
            fill, drop = free[: len(new)], free[len(new) :]
            lanes[fill], at[fill], step[fill], put[fill] = new, starts[new], 0, out_starts[new]
            last[fill] = out_starts[new] + steps[new]
            if len(drop):
                keep = np.ones(len(lanes), bool)
                keep[drop] = False
                lanes, at, step, put, last = (x[keep] for x in (lanes, at, step, put, last))
    given = [out[a : a + n + STRIDE] for a, n in zip(out_starts.tolist(), steps.tolist(), strict=True)]
    given = [g[: np.count_nonzero(g != END)] for g in given]
    return [np.concatenate([g, late[k]]) if k in late else g for k, g in enumerate(given)]


def _to_end(data: np.ndarray, at: int, step: int) -> np.ndarray:
    """What a walk at `at` gives out from `step` until the end of its text."""
    out = []
    while data[at] != END:
        out.append(data[at])
        at += int(DRAWS[step & (PERIOD - 1)] >> (int(data[at]) & 31)) & 1
        step += 1
    return np.array(out, np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text; 0 where a slot has no step yet. Equal texts have equal rows."""
    given = walk([_codes(t) for t in texts])
    longest = max((len(g) for g in given), default=0)
    steps, slots = _records(longest)
    salt = (_priority(steps) >> np.uint64(20)).astype(np.int64)
    out = np.zeros((len(texts), SLOTS), np.uint8)
    for row, g in zip(out, given, strict=True):
        n = int(np.searchsorted(steps, len(g)))
        chosen = np.full(SLOTS, -1)
        chosen[slots[:n]] = np.arange(n)
        used = chosen >= 0
        k = chosen[used]
        row[used] = 1 + (g[steps[k]].astype(np.int64) * 131 + salt[k]) % 255
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of slots that agree, among those that either has; 1 for two empty texts."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(used > 0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1), 1.0)


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """pid, ahead, id, tag, text: documents dealt by ranges of ids; ahead 1 marks a copy of the next range's first
    documents, 2 of the very first. Only the first ids of the ranges pass through the driver."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    share = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, share)), 10_000)).head()[0] if share else []
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("pid", range_of("id"))
    heads = sorted((r["m"], r["pid"]) for r in rows.groupBy("pid").agg(F.min("id").alias("m")).collect())
    copies: dict[int, list[tuple[int, int]]] = {}
    for (_, before), (first, _) in zip(heads, heads[1:]):
        copies.setdefault(first, []).append((before, 1))
    if heads:
        copies.setdefault(heads[0][0], []).append((heads[-1][1], 2))
    target = "array<struct<pid: int, ahead: int>>"
    also = rows.sparkSession.createDataFrame(list(copies.items()), f"c_id long, copies {target}")
    rows = rows.join(F.broadcast(also), F.col("id") == F.col("c_id"), "left")
    own = F.array(F.struct("pid", F.lit(0).alias("ahead"))).cast(target)
    everywhere = F.concat(own, F.coalesce("copies", F.array().cast(target)))
    return rows.select("id", F.xxhash64("text").alias("tag"), "text", F.explode(everywhere).alias("to")).select(
        "to.pid", "to.ahead", "id", "tag", "text"
    )


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of `_in_order` in, one row per document out, each with what follows it."""
    held: list[tuple[int, str, str]] = []
    chars, last = 0, None

    def finish() -> pd.DataFrame:
        own = [t for _, t, _ in held]
        changed = [edited(t, f) for _, t, f in held]
        follow = [f for (_, _, f), (_, t, _) in zip(held, held[1:]) if f is not t]  # followed by no row of this batch
        prints = fingerprints(own + changed + follow + [held[-1][2]])
        n = len(held)
        nexts, more = [], 2 * n
        for k, (_, _, f) in enumerate(held):
            if k + 1 < n and f is held[k + 1][1]:
                nexts.append(k + 1)
            else:
                nexts.append(more)
                more += 1
        mine, other = prints[:n], prints[n : 2 * n]
        return pd.DataFrame({
            "id": [i for i, _, _ in held], "n_chars": [len(t) for t in own], "edited_text": changed,
            "fingerprint": [p.tobytes().hex() for p in mine], "edited_fingerprint": [p.tobytes().hex() for p in other],
            "near_edited": likeness(mine, other), "near_next": likeness(mine, prints[nexts]),
        })

    for batch in batches:
        for pid, ahead, i, text in zip(batch["pid"], batch["ahead"], batch["id"], batch["text"], strict=True):
            if last is not None and last[0] == pid:
                held.append((last[1], last[2], text))
                chars += 2 * len(last[2])
                if chars >= BATCH_CHARS:
                    yield finish()
                    held, chars = [], 0
            last = (pid, i, text) if not ahead else None
    if held:
        yield finish()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Documents are in order of id, rows without an id (here NO_ID) first, ties by a hash of the text; the first
    follows the last, so a single document follows itself. Null text is empty. Equal texts have equal fingerprints;
    two empty texts are alike by 1. Repeated rows are documents that follow each other. An empty table gives no
    rows; other columns are ignored.
    """
    parts = shuffle_parts(docs.sparkSession)
    schema = (
        "id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    dealt = _in_order(docs, parts).repartition(parts, "pid")
    return dealt.sortWithinPartitions("pid", "ahead", "id", "tag").mapInPandas(released(_pairs), schema)


def _near_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (band, fingerprint) rows in, links that connect the near members of each band out."""
    band, members = None, []

    def links() -> pd.DataFrame:
        rest = np.array([np.frombuffer(bytes.fromhex(m), np.uint8) for m in members])
        names, found = np.array(members, object), []
        while len(rest) > 1:
            frontier, rest, names = [(rest[0], names[0])], rest[1:], names[1:]
            while frontier and len(rest):
                row, name = frontier.pop()
                near = likeness(rest, row[None, :]) >= LIKENESS
                found += [(name, other) for other in names[near]]
                frontier += list(zip(rest[near], names[near]))
                rest, names = rest[~near], names[~near]
        return pd.DataFrame(found, columns=["u", "v"])

    for batch in batches:
        for b, print_ in zip(batch["band"], batch["fingerprint"], strict=True):
            if b != band:
                if len(members) > 1:
                    yield links()
                band, members = b, []
            members.append(print_)
    if len(members) > 1:
        yield links()


def near_fingerprints(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct values of `fingerprint` with likeness of LIKENESS or more.

    Bands sample BAND neighbouring slots each; fingerprints that agree in a band are candidates and are verified by
    likeness over all slots. In a band the members found near each other are joined by a search, not by all pairs.
    """
    distinct = stage(prints.select("fingerprint").distinct(), "prints")
    width = 2 * BAND
    bands = F.array(*[
        F.concat(F.lit(f"{i}:"), F.substring("fingerprint", 1 + i * width, width)) for i in range(SLOTS // BAND)
    ])
    lists = distinct.select("fingerprint", F.explode(bands).alias("band"))
    parts = shuffle_parts(prints.sparkSession)
    return lists.repartition(parts, "band").sortWithinPartitions("band", "fingerprint").mapInPandas(
        released(_near_rows), "u string, v string"
    ).distinct()


def op6_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    return fingerprint_documents(table(spark, sf_dir, "documents")).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
