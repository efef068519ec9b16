"""Removal of repeated 100-byte strings by merging Burrows-Wheeler transforms of shards.

1. Windows that cannot be repeated are ruled out exactly. The least hash among a window's GRAM-byte strings depends
   only on its bytes, so equal windows have equal anchors. Windows in a row with the same anchor form a context;
   equal contexts are found by anchor and hash, and only the earliest context of each kind goes on.
2. Where an anchor has several different contexts, these are cut from the texts and sent to a bucket by anchor. There
   the contexts of each sender are a shard with its own transform. The shards' transforms are merged by refining
   their interleave two bytes at a time; the blocks that are left after 100 bytes are the repeated intervals.
3. The removed windows of a document come together with its text, which is cut once.

Long texts are worked on in pieces. Documents are ordered by id, then by a hash of the text; rows without an id come
first, and rows equal in id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import NO_ID, released, shuffle_parts, stage, table, text_tag

WINDOW = 100
GRAM = 44
REACH = WINDOW - GRAM + 1
#: Bytes hashed at once, bytes of texts that a sender packs together, bytes of contexts merged at once.
PIECE, SLAB, BLOCK = 1 << 20, 1 << 24, 1 << 20
#: An anchor with more different contexts is spread by its windows, each a context of its own.
HOT_CONTEXTS = 2_000
SEPARATOR = 255  # no byte of UTF-8
BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
BASE = np.uint32(0x9E3779B1)
PACKED = "part int, kind int, id long, tag long, data binary"


def _gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 32-bit hash of the `length` bytes from each position, put together from doubled lengths."""
    power, base, span, out, done = BYTES[data], BASE, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & span:
                tail = power if out is None else power[done:]
                n = len(data) - (done + span) + 1
                out = tail[:n] if out is None else out[:n] * base + tail[:n]
                done += span
            if done == length:
                break
            power, base, span = power[:-span] * base + power[span:], base * base, 2 * span
        out = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return out ^ (out >> np.uint32(12))


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the texts [starts, ends) of `data`: first window, number of windows, anchor. Anchors are leftmost
    least hashes, so the windows of one anchor are next to each other."""
    windows = np.maximum(ends - starts - WINDOW + 1, 0)
    if not windows.sum():
        return (np.empty(0, np.int64),) * 3
    best = _gram_hashes(np.frombuffer(data, np.uint8), GRAM).astype(np.uint64) << np.uint64(32)
    best |= np.arange(len(best), dtype=np.uint64)
    span = 1
    while span < REACH:
        step = min(span, REACH - span)
        best, span = np.minimum(best[:-step], best[step:]), span + step
    at = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    anchor = (best[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return at[first], np.diff(np.concatenate((first, [len(at)]))), anchor[first]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, ends, text number, offset in the text) of about PIECE bytes; long texts overlap by a window."""
    parts, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE):
            part = text[at : at + PIECE + WINDOW - 1]
            if parts and size + len(part) > 2 * PIECE:
                yield _joined(parts)
                parts, size = [], 0
            parts.append((part, i, at))
            size += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts: list) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p, _, _ in parts])
    ends = np.cumsum(sizes)
    return b"".join(p for p, _, _ in parts), ends - sizes, ends, np.array([i for _, i, _ in parts]), np.array([o for _, _, o in parts])


FIELDS = (("anchor", np.uint64), ("context", np.uint64), ("doc", np.uint32), ("at", np.int64), ("n", np.uint8), ("off", np.uint8))


def _pack(columns: list[np.ndarray]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(data: bytes, kinds: list) -> tuple[list[np.ndarray], int]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, at


def _runs(at: np.ndarray, n: np.ndarray, off: np.ndarray | None) -> bytes:
    return _pack([at.astype(np.int64), n.astype(np.int64)] + ([] if off is None else [off]))


def _by_document(
    kind: int, ids: np.ndarray, tags: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray | None = None
) -> pd.DataFrame:
    """One row for each document with its windows [at, at + n), neighbours joined; or, with the anchors' offsets `off`,
    with its contexts as they are."""
    order = np.lexsort((at, tags, ids))
    off = None if off is None else off[order].astype(np.int64)
    ids, tags, at, n = ids[order], tags[order], at[order], n[order].astype(np.int64)
    new_doc = np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))[: len(ids)]
    cut = np.flatnonzero(new_doc | (off is not None) | np.concatenate(([True], at[1:] != at[:-1] + n[:-1]))[: len(ids)])
    if len(cut):
        n, ids, tags, at = np.add.reduceat(n, cut), ids[cut], tags[cut], at[cut]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))[: len(ids)])
    edges = [*first.tolist(), len(ids)]
    return pd.DataFrame({
        "part": np.zeros(len(first), np.int32), "kind": np.full(len(first), kind, np.int32),
        "id": ids[first], "tag": tags[first],
        "data": [_runs(at[a:b], n[a:b], None if off is None else off[a:b]) for a, b in zip(edges, edges[1:])],
    })


def _contexts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    found: list[list[np.ndarray]] = []
    digest = xxhash.xxh64_intdigest
    for data, starts, ends, number, offset in _pieces(texts):
        at, n, anchor = anchors(data, starts, ends)
        text = np.searchsorted(ends, at, side="right")
        grams = [digest(data[a : a + GRAM]) for a in anchor.tolist()]
        whole = [digest(data[a:b], 1) for a, b in zip(at.tolist(), (at + n + WINDOW - 1).tolist(), strict=True)]
        found.append([
            np.array(grams, np.uint64), np.array(whole, np.uint64), number[text].astype(np.uint32),
            at - starts[text] + offset[text], n.astype(np.uint8), (anchor - at).astype(np.uint8),
        ])
    if not found:
        return {name: np.empty(0, kind) for name, kind in FIELDS}
    return {name: np.concatenate([f[i] for f in found]) for i, (name, _) in enumerate(FIELDS)}


def _send(buckets: int):
    """Packs the distinct contexts of about SLAB bytes of texts for each bucket; local repeats are known to go."""

    def slab(rows: dict[tuple[int, int], bytes]) -> Iterator[pd.DataFrame]:
        keys = sorted(rows)
        ids, tags = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
        c = _contexts_of([rows[k] for k in keys])
        order = np.argsort(c["context"], kind="stable")
        same = (c["context"][order][1:] == c["context"][order][:-1]) & (c["anchor"][order][1:] == c["anchor"][order][:-1])
        again = order[1:][same]
        doc = c["doc"][again]
        known = _by_document(0, ids[doc], tags[doc], c["at"][again], c["n"][again])
        yield known.assign(part=((known["id"] ^ known["tag"]) % buckets).astype(np.int32))
        keep = np.ones(len(order), bool)
        keep[again] = False
        bucket = (c["anchor"] % np.uint64(buckets)).astype(np.int64)
        for b in range(buckets):
            mine = np.flatnonzero(keep & (bucket == b))
            if not len(mine):
                continue
            docs, index = np.unique(c["doc"][mine], return_inverse=True)
            columns = [c[name][mine] for name, _ in FIELDS]
            columns[2] = index.astype(np.uint32)
            data = _pack([ids[docs], tags[docs]]) + _pack(columns)
            yield pd.DataFrame({"part": [b], "kind": [9], "id": [0], "tag": [0], "data": [data]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = {}, 0
        for batch in batches:
            for i, tag, text in zip(batch["id"], batch["tag"], batch["text"], strict=True):
                data = text.encode()
                if len(data) >= WINDOW:
                    rows[(i, tag)] = data
                    size += len(data)
                if size >= SLAB:
                    yield from slab(rows)
                    rows, size = {}, 0
        if rows:
            yield from slab(rows)

    return run


def _later(group: np.ndarray, ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each group, those that are at another place than the first), as positions."""
    order = np.lexsort((at, tags, ids, group))
    g = group[order]
    head = np.concatenate(([True], g[1:] != g[:-1]))[: len(g)]
    first = order[head][np.cumsum(head) - 1]
    other = (ids[order] != ids[first]) | (tags[order] != tags[first]) | (at[order] != at[first])
    return order[head], order[other]


def _reduce_bucket(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
    parts = []
    for blob in blobs:
        (ids, tags), used = _unpack(blob, [np.int64, np.int64])
        columns, _ = _unpack(blob[used:], [kind for _, kind in FIELDS])
        parts.append([columns[0], columns[1], ids[columns[2]], tags[columns[2]], columns[3], columns[4], columns[5]])
    anchor, context, ids, tags, at, n, off = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(context, kind="stable")
    kind = np.concatenate(([True], context[order][1:] != context[order][:-1]))[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(kind)
    several = np.flatnonzero(np.bincount(group, minlength=2)[group] > 1)
    _, again = _later(group[several], ids[several], tags[several], at[several])
    again = several[again]
    # a repeated row of the same document is neither first nor later: it is asked for twice and told apart then
    yield _by_document(0, ids[again], tags[again], at[again], n[again])
    keep = np.ones(len(order), bool)
    keep[again] = False
    rest = np.flatnonzero(keep)
    rest = rest[np.argsort(anchor[rest], kind="stable")]
    heads = np.flatnonzero(np.concatenate(([True], anchor[rest][1:] != anchor[rest][:-1]))[: len(rest)])
    sizes = np.diff(np.concatenate((heads, [len(rest)])))
    sizes = np.repeat(sizes, sizes)
    for kind, chosen in ((1, (sizes > 1) & (sizes <= HOT_CONTEXTS)), (2, sizes > HOT_CONTEXTS)):
        wanted = rest[chosen]
        if len(wanted):
            yield _by_document(kind, ids[wanted], tags[wanted], at[wanted], n[wanted], off[wanted])


def _collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by part: passes kind 0 on, and reduces each part's packed contexts."""
    part, blobs = None, []
    for batch in batches:
        for p in batch["part"].unique():
            rows = batch[batch["part"] == p]
            if p != part and blobs:
                yield from _reduce_bucket(blobs)
                blobs = []
            part = p
            packed = rows["kind"] == 9
            if (~packed).any():
                yield rows[~packed]
            blobs += rows.loc[packed, "data"].tolist()
    if blobs:
        yield from _reduce_bucket(blobs)


def _cut(buckets: int):
    """Cuts the wanted contexts from the texts and packs them by bucket.

    Of equal windows of hot anchors only the earliest of a slab is sent on, the others are known to go (kind 0).
    """

    def slab(found: list[list], first: dict[bytes, tuple[int, int, int]], later: list[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        found += [[xxhash.xxh64_intdigest(w), *place, 0, w] for w, place in first.items()]
        yield _packed_contexts(found, buckets)
        if later:
            ids, tags, at = (np.array(c, np.int64) for c in zip(*later))
            out = _by_document(0, ids, tags, at, np.ones(len(at), np.int64))
            yield out.assign(part=((out["id"] ^ out["tag"]) % buckets).astype(np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, first, later = [], {}, []
        size = 0
        for batch in batches:
            for i, tag, text, near, hot in zip(*(batch[c] for c in ("id", "tag", "text", "near", "hot")), strict=True):
                data = text.encode()
                for blobs, single in ((near, False), (hot, True)):
                    for blob in blobs:
                        (at, n, offsets), _ = _unpack(blob, [np.int64] * 3)
                        for a, m, off in zip(at.tolist(), n.tolist(), offsets.tolist(), strict=True):
                            part = data[a : a + m + WINDOW - 1]
                            if single:
                                for k in range(m):
                                    w, place = part[k : k + WINDOW], (i, tag, a + k)
                                    known = first.setdefault(w, place)
                                    if known != place:
                                        first[w] = min(known, place)
                                        later.append(max(known, place))
                                    size += WINDOW
                            else:
                                size += len(part)
                                found.append([xxhash.xxh64_intdigest(part[off : off + GRAM]), i, tag, a, off, part])
                if size >= SLAB:
                    yield from slab(found, first, later)
                    found, first, later, size = [], {}, [], 0
        if size:
            yield from slab(found, first, later)

    return run


def _packed_contexts(found: list[list], buckets: int) -> pd.DataFrame:
    bucket = np.array([f[0] for f in found], np.uint64) % np.uint64(buckets)
    rows = []
    for b in np.unique(bucket):
        mine = [found[k] for k in np.flatnonzero(bucket == b)]
        columns = [np.array([f[c] for f in mine], kind) for c, kind in ((0, np.uint64), (1, np.int64), (2, np.int64), (3, np.int64), (4, np.int64))]
        columns.append(np.array([len(f[5]) for f in mine], np.int64))
        rows.append((int(b), 9, 0, 0, _pack(columns) + b"".join(f[5] for f in mine)))
    return pd.DataFrame(rows, columns=["part", "kind", "id", "tag", "data"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _longest_common(parts: list[bytes]) -> list[int]:
    """For each string, the longest beginning that it shares with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for x, y in zip(order, order[1:]):
        n = _common(parts[x], parts[y])
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


def _crop(members: list[tuple]) -> list[tuple]:
    """What the contexts of an anchor may share: no further from the anchor than any other context agrees."""
    out = []
    right = _longest_common([m[5][m[4] + GRAM :] for m in members])
    left = _longest_common([m[5][: m[4]][::-1] for m in members])
    for m, a, b in zip(members, left, right, strict=True):
        if a + GRAM + b >= WINDOW:
            start = m[4] - a
            out.append((m[1], m[2], m[3] + start, m[5][start : m[4] + GRAM + b], m[6]))
    return out


def sort_shards(text: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Suffixes of `text` sorted within each shard (ascending numbers) by their first 96 bytes or more."""
    n = len(text)
    key = shard.astype(np.uint64)
    padded = np.concatenate((text, np.full(8, SEPARATOR, np.uint8))).astype(np.uint64)
    for k in range(6):
        key = (key << np.uint64(8)) | padded[k : k + n]
    span = 6
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        change = np.concatenate(([False], ranked[1:] != ranked[:-1]))
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(change).astype(np.uint64)
        if span >= WINDOW or change.sum() == n - 1:
            return order
        key = (rank << np.uint64(32)) | np.concatenate((rank[span:], np.zeros(min(span, n), np.uint64)))[:n]
        span *= 2


def merge_transforms(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The block of each position of `text`, which is the shards of `sizes` one after another: positions are in one
    block if their next WINDOW bytes are equal (for positions that have no separator within them).

    Every shard gives its transform, the pair of bytes before each of its sorted suffixes. The interleave says which
    shard each suffix of the merged order comes from. Reading the transforms in this order and sorting stably by the
    pair gives the interleave for two more bytes; blocks split where the pair or the earlier block differs.
    """
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    order = sort_shards(text, shard)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)[order]
    size = np.repeat(sizes, sizes)[order]
    one, two = (text[start + (order - start - k) % size].astype(np.uint16) for k in (1, 2))  # around the shard's end
    transform = (two << np.uint16(8)) | one
    interleave, block = shard.copy(), np.zeros(len(text), np.int32)
    for _ in range(WINDOW // 2):
        pairs = np.empty(len(text), np.uint16)
        pairs[np.argsort(interleave, kind="stable")] = transform
        moved = np.argsort(pairs, kind="stable")
        after, pairs, before = interleave[moved], pairs[moved], block[moved]
        split = (pairs[1:] != pairs[:-1]) | (before[1:] != before[:-1])
        refined = np.concatenate(([0], np.cumsum(split))).astype(np.int32)
        settled = np.array_equal(after, interleave) and np.array_equal(refined, block)
        interleave, block = after, refined
        if settled:
            break
    out = np.empty(len(text), np.int32)
    out[order] = block[np.argsort(interleave, kind="stable")]
    return out


def _merge_block(contexts: list[tuple]) -> pd.DataFrame:
    """Windows (kind 0) of the contexts (id, tag, at, text, sender) that are equal to an earlier one."""
    contexts.sort(key=lambda c: c[4])
    senders = np.array([c[4] for c in contexts])
    lengths = np.array([len(c[3]) + 1 for c in contexts])
    text = np.frombuffer(b"".join(c[3] + b"\xff" for c in contexts), np.uint8)
    sizes = np.add.reduceat(lengths, np.flatnonzero(np.concatenate(([True], senders[1:] != senders[:-1]))))
    block = merge_transforms(text, sizes)
    windows = lengths - WINDOW
    number = np.repeat(np.arange(len(contexts)), windows)
    within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    group = block[(np.cumsum(lengths) - lengths)[number] + within]
    ids, tags, at = (np.array([c[k] for c in contexts], np.int64)[number] for k in range(3))
    at = at + within
    _, later = _later(group, ids, tags, at)
    return _by_document(0, ids[later], tags[later], at[later], np.ones(len(later), np.int64))


def _merge_bucket(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
    members, texts = [], []
    for sender, blob in enumerate(blobs):
        columns, at = _unpack(blob, [np.uint64] + [np.int64] * 5)
        ends = np.cumsum(columns[5]) + at
        texts.append((blob, (ends - columns[5]).tolist(), ends.tolist()))
        members.append((np.full(len(ends), sender), np.arange(len(ends)), *columns[:5]))
    sender, row, anchor, ids, tags, at, off = (np.concatenate(x) for x in zip(*members, strict=True))
    order = np.argsort(anchor, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1], [True])))
    block, size = [], 0
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        group = []
        for k in order[a:b].tolist():
            blob, starts, ends = texts[sender[k]]
            text = blob[starts[row[k]] : ends[row[k]]]
            group.append((anchor[k], int(ids[k]), int(tags[k]), int(at[k]), int(off[k]), text, int(sender[k])))
        if len(group) < 2:
            continue
        single = all(len(g[5]) == WINDOW for g in group)
        kept = [(g[1], g[2], g[3], g[5], g[6]) for g in group] if single else _crop(group)
        block += kept
        size += sum(len(c[3]) for c in kept)
        if size >= BLOCK:
            yield _merge_block(block)
            block, size = [], 0
    if block:
        yield _merge_block(block)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, blobs = None, []
    for batch in batches:
        packed = batch["kind"] == 9
        if (~packed).any():
            yield batch[~packed]
        for p, data in zip(batch.loc[packed, "part"], batch.loc[packed, "data"], strict=True):
            if p != part and blobs:
                yield from _merge_bucket(blobs)
                blobs = []
            part = p
            blobs.append(data)
    if blobs:
        yield from _merge_bucket(blobs)


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts the texts; columns that only pass through stay."""
    for batch in batches:
        found = []
        for text, blobs in zip(batch["text"], batch["gone"], strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            for blob in blobs if blobs is not None else ():
                (at, n), _ = _unpack(blob, [np.int64, np.int64])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n + WINDOW - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            found.append((len(data), int(gone.sum()), spans, data[~gone].tobytes()))
        out = pd.DataFrame(found, columns=["n_bytes", "n_removed", "n_spans", "kept"])
        yield pd.concat([batch.drop(columns=["text", "gone"]).reset_index(drop=True), out], axis=1)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, tag, the string columns `keep`, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row; id
    NO_ID stands for null.

    A byte goes if it is covered by a WINDOW-byte string that also starts earlier. Null text is empty; texts shorter
    than WINDOW stay. Rows equal in id and text are one document and get the same result each; rows equal in id
    only are ordered by their text's hash. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    buckets = max(4, parts)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), *keep
    ).select("id", text_tag().alias("tag"), "text", *keep)
    sent = rows.select("id", "tag", "text").mapInPandas(released(_send(buckets)), PACKED).repartition(parts, "part").sortWithinPartitions("part")
    asked = stage(sent.mapInPandas(released(_collect), PACKED), "repeat-candidates")
    lists = [F.collect_list(F.when(F.col("kind") == k, F.col("data"))).alias(name) for k, name in ((1, "near"), (2, "hot"))]
    wanted = asked.where("kind > 0").groupBy(F.col("id").alias("w_id"), F.col("tag").alias("w_tag")).agg(*lists)
    cut = rows.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("tag") == F.col("w_tag")))
    cut = cut.select("id", "tag", "text", "near", "hot").mapInPandas(released(_cut(buckets)), PACKED)
    merged = cut.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(released(_merge), PACKED)
    gone = asked.where("kind = 0").union(merged).groupBy(F.col("id").alias("g_id"), F.col("tag").alias("g_tag"))
    gone = gone.agg(F.collect_list("data").alias("gone"))
    whole = rows.join(gone, (F.col("id") == F.col("g_id")) & (F.col("tag") == F.col("g_tag")), "left")
    schema = ", ".join(["id long, tag long", *[f"`{c}` string" for c in keep], "n_bytes long, n_removed long, n_spans long, kept binary"])
    return whole.select("id", "tag", *keep, "text", "gone").mapInPandas(released(_apply), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, n_chars) with the remaining text and its length. Bytes of a
    character that was cut apart are dropped, and a text may become empty; no row goes."""
    @F.pandas_udf("string")
    def decoded(kept: pd.Series) -> pd.Series:
        return kept.map(lambda data: bytes(data).decode("utf-8", "ignore"))

    left = remove_repeats(docs, ("lang", "source")).withColumn("text", decoded("kept"))
    return left.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "lang", "source",
        F.length("text").cast("long").alias("n_chars"),
    )


def op5_repeated_strings(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
