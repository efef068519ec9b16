"""Ranked lexical search by MaxScore whose bounds come from pairs of terms.

A first pass cuts every document into terms and writes the postings of the items' terms; document frequencies and
lengths follow by aggregation. A second pass indexes the postings in blocks of documents. In a block each term has
its list with impacts (its share of a score) and their maximum. Each item's terms are paired in order of weight, and
for each pair the intersection of its lists is stored with the joint impacts: no document gets more from a pair than
the larger of both maxima and the joint maximum, which is less than their sum wherever the maxima lie in different
documents. Pairs of least bounds that together stay below the score of the item's last place are not essential: only
documents in the other lists are candidates, and these are dropped once their score and the bounds of what is left
fall short. Every task keeps an item's best documents over its blocks; a window ranks what the tasks found.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import released, stage, table

#: Characters of items that are searched at once, about 20 bytes of lists and names in each worker for one.
ITEM_CHARS = 2_000_000
#: Postings that are indexed at once (some 40 bytes each, pairs included).
BLOCK_POSTINGS = 1_500_000
#: Documents of one pair list that are scored to raise an item's threshold before its lists are read.
SEEDS = 4
#: Bytes of a text's UTF-8 form: letters and digits of ASCII and all beyond stay, A-Z in lower case, the rest parts terms.
TERM_BYTES = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_letters + string.digits else b if b > 127 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


def _postings(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = [(vocabulary[w], tf) for w, tf in Counter(words).items() if w in vocabulary]
                sizes.append(len(words))
                terms += [t for t, _ in found]
                tfs += [tf for _, tf in found]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


class Block:
    """The index of one block of documents: lists by term, and joint impacts of pairs of terms."""

    def __init__(self, n, ends, terms, tfs, weights, documents: int, length: int):
        self.docs = len(n)
        m = 50 + (50 * n * documents) // length
        doc = np.repeat(np.arange(self.docs), np.diff(ends))
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.doc[part], self.impact[part]

    def add_pair(self, pair: tuple[int, int]) -> None:
        """Stores the intersection of two lists, the joint impacts and the most that a document gets from the pair."""
        (few, small), (many, large) = sorted(map(self.list_of, pair), key=lambda x: len(x[0]))
        most = max(small.max(initial=0), large.max(initial=0))
        if not len(few):
            self.pairs[pair] = few, small, int(most)
            return
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        both = many[at] == few
        joint = small[both] + large[at[both]]
        self.pairs[pair] = few[both], joint, int(max(most, joint.max(initial=0)))

    def gains(self, terms, candidates: np.ndarray) -> np.ndarray:
        """What each of the candidates gets from `terms`."""
        total = np.zeros(len(candidates), np.int64)
        for term in terms:
            docs, impact = self.list_of(term)
            if len(docs):
                at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                total += np.where(docs[at] == candidates, impact[at], 0)
        return total

    def search(self, units: list[tuple[int, ...]], least: int, k: int, pair_bounds: bool = True):
        """Candidates with a score of at least `least`, their scores, and how many documents were scored."""
        bounds = [self.pairs[u][2] if len(u) == 2 and pair_bounds else
                  sum(int(self.list_of(t)[1].max(initial=0)) for t in u) for u in units]
        ranked = sorted(zip(bounds, units, strict=True))
        below = np.cumsum([0] + [b for b, _ in ranked])  # below[j]: the most that the first j units add
        none = np.zeros(0, np.int64)
        if below[-1] < least or not ranked:
            return none, none, 0
        best = ranked[-1][1]
        if pair_bounds and len(best) == 2 and len(self.pairs[best][0]) >= k:
            docs, joint, _ = self.pairs[best]
            seeds = docs[np.argpartition(joint, -min(len(joint), SEEDS * k))[-SEEDS * k:]]
            scores = self.gains([t for u in units for t in u], seeds)
            least = max(least, int(np.partition(scores, -k)[-k]))
        free = int(np.searchsorted(below, least, "left")) - 1  # units that together stay below
        scores = np.zeros(self.docs, np.int64)
        for _, unit in ranked[free:]:
            for term in unit:
                docs, impact = self.list_of(term)
                scores[docs] += impact
        touched = int(np.count_nonzero(scores))
        candidates = np.flatnonzero((scores > 0) & (scores + below[free] >= least))
        scores = scores[candidates]
        for j in range(free - 1, -1, -1):
            scores = scores + self.gains(ranked[j][1], candidates)
            kept = scores + below[j] >= least
            candidates, scores = candidates[kept], scores[kept]
        return candidates, scores, touched


def _best(score, has_id, doc_id, k: int):
    """The first k by score, then rows without an id, then by id."""
    order = np.lexsort((doc_id, has_id, -score))[:k]
    return score[order], has_id[order], doc_id[order]


def _search(items: list[tuple[int | None, list[tuple[int, ...]]]], weights: np.ndarray, documents: int, length: int, k: int):
    pairs = sorted({u for _, units in items for u in units if len(u) == 2})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]

        def index(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            terms, tfs, n = (rows.column(c).combine_chunks() for c in ("terms", "tfs", "n"))
            ids = rows.column("doc_id").combine_chunks()
            has_id = ids.is_valid().to_numpy(zero_copy_only=False)
            doc_id = ids.fill_null(0).to_numpy()
            block = Block(n.to_numpy(), np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy()))),
                          terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), weights, documents, length)
            for pair in pairs:
                block.add_pair(pair)
            for i, (_, units) in enumerate(items):
                score, *_ = kept[i]
                found, scores, _ = block.search(units, int(score[-1]) if len(score) == k else 1, k)
                if len(found):
                    kept[i] = _best(*(np.concatenate(x) for x in zip(
                        kept[i], (scores, has_id[found], doc_id[found]), strict=True)), k)

        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            if postings >= BLOCK_POSTINGS:
                index(held)
                held, postings = [], 0
        if held:
            index(held)
        for i, (item_id, _) in enumerate(items):
            score, has_id, doc_id = kept[i]
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(score), pa.int32()), pa.array([item_id] * len(score), pa.int64()),
                     pa.array(doc_id, pa.int64(), mask=~has_id), pa.array(score)],
                    names=["item", "item_id", "doc_id", "score"],
                )

    return run


def _units(terms: list[int]) -> list[tuple[int, ...]]:
    """Neighbours in `terms` as pairs; the last one stays alone if their number is odd."""
    return [tuple(terms[i : i + 2]) for i in range(0, len(terms), 2)]


def _rank_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    named = [(i, sorted(set(terms_of(text)))) for i, text in items]
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in named for t in terms}))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    postings = stage(
        rows.mapInArrow(released(_postings(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = totals.documents, totals.length or 1
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    asked = [(i, _units(sorted((vocabulary[t] for t in terms), key=lambda t: (weights[t], t)))) for i, terms in named]
    found = postings.where("size(terms) > 0").mapInArrow(
        released(_search(asked, weights, documents, length, k)), "item int, item_id long, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def rank_items(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of `docs` with the highest scores above 0 for each row of `items`.

    `docs` has doc_id and text, `items` item_id and text; other columns are ignored. Equal scores rank by doc_id, rows
    without one first; rows equal in both are ranked one by one in any order. Rows of `items` that are equal in id and
    text count once, rows with one id and different texts are ranked apart under that id. Null and empty texts have no
    terms: such a document counts nowhere, such an item has no rows. Empty tables give no rows. Texts are read whole.
    The items' terms are known to every worker: items are searched in blocks of about ITEM_CHARS characters. A task
    gives out k rows for an item, however many documents match.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text IS NOT NULL").distinct()
    chars = asked.agg(F.sum(F.length("text")).alias("chars")).first().chars or 0
    blocks = -(-chars // ITEM_CHARS) or 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    ranked = [
        _rank_block(docs, sorted(map(tuple, asked.where(number == b).collect()), key=repr), k) for b in range(blocks)]
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best documents of each benchmark item."""
    return rank_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (
    f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM lengths),
items AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(terms)) AS t
  FROM (SELECT DISTINCT item_id, {_TERMS} AS terms FROM benchmark)),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM docs)
  WHERE t IN (SELECT t FROM items) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * N_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY t, N_docs),
scores AS (
  SELECT i.i, i.item_id, p.r, l.doc_id,
    CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + ((50 * l.n * N_docs) // L))))) AS BIGINT) AS score
  FROM items i JOIN postings p ON i.t = p.t JOIN weights w ON w.t = i.t JOIN lengths l ON l.r = p.r, totals
  GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
    doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
