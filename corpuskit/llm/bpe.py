"""Byte-level BPE encoding and decoding through recursive DuckDB queries in each partition.

A partition collects the words that its texts have and that it has not encoded yet. DuckDB holds one row for each
token position of these words, joins neighbouring tokens with the merge table, contracts every word's leftmost pair
of least rank and repeats this until no word has a pair; an ordered aggregation over the positions decodes. Texts
are put together from their words' ids. Words of more than LONG_WORD bytes, whose rows would grow with the square
of their length, take the same contractions from a priority queue.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import released, table

#: Unicode white space; Python's own class also has the four separators U+001C to U+001F.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_WORD = 256
#: Words for one DuckDB query, and words that a task remembers (about 200 bytes each).
WORDS_AT_ONCE = 8_000
REMEMBERED = 300_000
#: Characters of texts that are put together at once.
BATCH_CHARS = 1_000_000

#: Positions of a word and what follows them: `pair` is the ids of a token and its right neighbour, `nxt` where that one
#: starts. A word whose tokens have no pair left takes no part in further steps.
ENCODE = """
WITH RECURSIVE steps(w, pos, id, nxt, pair, step) AS (
  SELECT w, pos, id, nxt, pair, step FROM bytes_of_words
  UNION ALL
  SELECT s.w, s.pos, CASE WHEN s.pos = b.pos THEN b.rank ELSE s.id END, CASE WHEN s.pos = b.pos THEN b.after ELSE s.nxt END,
    CASE WHEN s.pos = b.pos THEN b.rank * 65536 + b.after_id WHEN s.nxt = b.pos THEN s.id * 65536 + b.rank ELSE s.pair END,
    CAST(s.step + 1 AS SMALLINT)
  FROM steps s JOIN (
    SELECT f.w, f.least // 1048576 AS rank, CAST((f.least // 1024) % 1024 AS SMALLINT) AS pos, r.pos AS gone, r.nxt AS after,
      r.pair % 65536 AS after_id
    FROM (SELECT w, min(CAST(rank AS BIGINT) * 1048576 + CAST(pos AS BIGINT) * 1024 + nxt) AS least FROM steps JOIN merges USING (pair) GROUP BY w) f
    JOIN steps r ON r.w = f.w AND r.pos = CAST(f.least % 1024 AS SMALLINT)) b ON s.w = b.w
  WHERE s.pos <> b.gone)
SELECT w, pos, id FROM steps JOIN (SELECT w, max(step) AS step FROM steps GROUP BY w) USING (w, step)
"""
DECODE = """
SELECT w, list(CAST(id AS INTEGER) ORDER BY pos) AS ids, string_agg(bytes, '' ORDER BY pos) AS text
FROM tokens JOIN vocabulary USING (id) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are also their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def split_pattern(pattern: str):
    r"""A function from a text to its words by `pattern`, with \s and \S spelled out as Unicode white space.

    Texts of ASCII characters alone take the same pattern with the ASCII members of its classes, which is faster.
    """
    full, plain, inside, at = "", "", False, 0
    while at < len(pattern):
        token = pattern[at : at + 5] if pattern[at : at + 5] in (r"\p{L}", r"\p{N}") else pattern[at : at + 2]
        token = token if token[0] == "\\" else token[0]
        known = {
            r"\s": (SPACES, r"\t-\r "), r"\p{L}": (token, "A-Za-z"), r"\p{N}": (token, "0-9"),
            r"\S": (f"^{SPACES}", r"^\t-\r "),
        }.get(token if not (inside and token == r"\S") else "")
        if known:
            full += known[0] if inside or known[0] == token else f"[{known[0]}]"
            plain += known[1] if inside else f"[{known[1]}]"
        else:
            inside = token == "[" or inside and token != "]"
            full, plain = full + token, plain + token
        at += len(token)
    exact = regex.compile(full).findall
    if r"\p" in plain:
        return exact
    ascii_only = re.compile(plain).findall
    return lambda text: ascii_only(text) if text.isascii() else exact(text)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: its leftmost pair of least rank is contracted until none is left."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start of a token; end 0: contracted away
    queue = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(queue)

    def push(start: int) -> None:
        if end[start] < n and (rank := ranks.get(word[start : end[end[start]]])) is not None:
            heapq.heappush(queue, (rank, start, end[end[start]]))

    while queue:
        _, start, stop = heapq.heappop(queue)
        middle = end[start]
        if not middle or middle >= n or not end[middle] or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < n:
            before[stop] = start
        push(start)
        if before[start] >= 0:
            push(before[start])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


class WordCoder:
    """Ids of words as int32 bytes, by DuckDB, each decoded again; one for each task.

    Decoded bytes are kept only where they are not the word's own. Of the words met, those of the last REMEMBERED are
    remembered, in two halves of which the older one is dropped when the younger is full: words in use stay.
    """

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.differ: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        if max(self.ranks.values()) >= 65536:
            raise ValueError("ids must be below 65,536")
        pairs = [
            (left * 65536 + right, rank)
            for token, rank in self.ranks.items() for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self._load("merges", {"pair": [p for p, _ in pairs], "rank": [r for _, r in pairs]})
        self._load("vocabulary", {
            "id": list(self.ranks.values()), "bytes": [t.decode("latin-1") for t in self.ranks]})

    def close(self) -> None:
        """Gives the database and all words back; Spark keeps the worker for tasks of other kinds."""
        self.duck.close()
        self.ranks, self.young, self.old, self.differ = {}, {}, {}, {}

    def _load(self, name: str, columns: dict) -> None:
        self.duck.register("given", pa.table(columns))
        self.duck.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.duck.unregister("given")

    def _short(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        pos = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        self._load("bytes_of_words", {
            "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int16), "id": ids,
            "nxt": pa.array((pos + 1).astype(np.int16), mask=last), "pair": pa.array(ids * 65536 + np.roll(ids, -1), mask=last),
            "step": np.zeros(len(ids), np.int16),
        })
        self.duck.execute(f"CREATE OR REPLACE TEMP TABLE tokens AS {ENCODE}")
        found = self.duck.sql(DECODE).to_arrow_table().combine_chunks()
        lists = found.column("ids").chunk(0)
        values, cuts = lists.flatten().to_numpy().astype(np.int32).tobytes(), (lists.offsets.to_numpy() * 4).tolist()
        for a, b, text in zip(cuts, cuts[1:], found.column("text").to_pylist(), strict=False):
            yield values[a:b], text.encode("latin-1")

    def _remember(self, word: str, ids: bytes) -> None:
        if len(self.young) >= REMEMBERED // 2:
            self.old, self.young = self.young, {}
        self.young[word] = ids

    def code(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all `words`."""
        out, new = {}, []
        for word in words:
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    new.append(word)
                    continue
                self._remember(word, ids)
            out[word] = ids
        new.sort()
        bytes_of = {w: w.encode() for w in new}
        short = [w for w in new if len(bytes_of[w]) <= LONG_WORD]
        names = None
        for w in new:
            if len(bytes_of[w]) > LONG_WORD:
                names = names or {rank: token for token, rank in self.ranks.items()}
                ids = merge_long(bytes_of[w], self.ranks)
                self._add(out, w, np.array(ids, np.int32).tobytes(), b"".join(names[i] for i in ids), bytes_of[w])
        for at in range(0, len(short), WORDS_AT_ONCE):
            part = short[at : at + WORDS_AT_ONCE]
            for w, (ids, decoded) in zip(part, self._short([bytes_of[w] for w in part]), strict=True):
                self._add(out, w, ids, decoded, bytes_of[w])
        return out

    def _add(self, out: dict[str, bytes], word: str, ids: bytes, decoded: bytes, own: bytes) -> None:
        out[word] = ids
        self._remember(word, ids)
        if decoded != own:
            self.differ[word] = decoded


def _round_trip(texts: list[str], coder: WordCoder, split) -> tuple[list[bytes], list[bytes]]:
    words = [split(t) for t in texts]
    known = coder.code(set().union(*words))
    ids = [b"".join([known[w] for w in found]) for found in words]
    if not coder.differ:
        return ids, ["".join(found).encode() for found in words]
    return ids, [b"".join([coder.differ.get(w) or w.encode() for w in found]) for found in words]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (the bytes of the ids) for every row.

    `vocabulary` is the path of a .tiktoken file that every worker can read, `pattern` cuts a text into words; what
    no word covers is dropped, as the tiktoken library does. Special tokens are ordinary text. Null and empty texts
    have no ids. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, cut = WordCoder(vocabulary), split_pattern(pattern)
        try:
            yield from encode(batches, coder, cut)
        finally:
            coder.close()

    def encode(batches: Iterator[pa.RecordBatch], coder: WordCoder, cut) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            start, chars = 0, 0
            for at, text in enumerate(texts):
                chars += len(text)
                if chars >= BATCH_CHARS or at + 1 == len(texts):
                    ids, decoded = _round_trip(texts[start : at + 1], coder, cut)
                    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids[start : at + 1], pa.ListArray.from_arrays(ends, values), pa.array(decoded, pa.binary())],
                        names=["doc_id", "ids", "decoded"],
                    )
                    start, chars = at + 1, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encoded_digests(docs: DataFrame) -> DataFrame:
    """The round trip of `docs` in the public multi-language vocabulary, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode_documents(docs, str(path), public_tokenizers.PATTERN))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return encoded_digests(table(spark, sf_dir, "documents"))
