"""Ranked search against scores of all documents, and what pair bounds save."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    out = []
    for item_id, text in {(i, t) for i, t in items if t}:
        scored = []
        for row, (doc_id, c) in enumerate(counts):
            m = 50 + (50 * sum(c.values()) * n_docs) // max(length, 1)
            score = 0
            for t in set(terms(text)) & c.keys():
                df = sum(t in d for _, d in counts)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id, row))
        out += [(item_id, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["Alpha", "béta", "GAMMA", "É", "x1", "日本", *(f"w{i}" for i in range(60))]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(300)]
    docs += [(400 + i, docs[3][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[6][1]), (None, None), (900, ""), (901, " .,;")]
    docs += [(902, "w1 " * 200_000 + "w2 " + "y" * 300_000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(25)]
    return docs, [*items, items[0], (1, "w3 w4"), (None, "béta É"), (50, None), (51, ""), (52, "nowhere"), (53, "w9 nowhere")]


@pytest.mark.parametrize(("postings", "chars", "k"), [(1_500_000, 2_000_000, 50), (300, 200, 7)])
def test_against_all_scores(spark, rows, monkeypatch, postings, chars, k):
    docs, items = rows
    monkeypatch.setattr(lexical, "ITEM_CHARS", chars)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    table = spark.createDataFrame(docs, DOCS).repartition(4).withColumns(
        {n: F.lit("extra") for n in ("n", "terms", "tfs", "score", "rank", "item_id")})
    asked = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit("extra"))
    got = lexical.rank_items(table, asked, k)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(docs, items, k)


def test_nothing(spark, rows):
    docs, items = (spark.createDataFrame(r, s) for r, s in zip(rows, (DOCS, ITEMS), strict=True))
    assert lexical.rank_items(docs.limit(0), items).count() == 0
    assert lexical.rank_items(docs, items.limit(0)).count() == 0
    assert lexical.rank_items(docs.where("text = ''"), items).count() == 0


def test_pair_bounds_skip_more():
    """Two terms that are heavy in different documents: their sum may reach the threshold, no document does."""
    n = np.full(1000, 10)
    terms_, tfs, ends = [], [], [0]
    for d in range(1000):
        found = {0: 9 if d % 2 else 1} if d < 500 else {1: 9 if d % 2 else 1}
        if d % 10 == 0:
            found = {2: 5, 3: 5}
        terms_ += found.keys()
        tfs += found.values()
        ends.append(len(terms_))
    weights = np.array([1000, 1100, 1200, 1300])
    block = lexical.Block(n, np.array(ends), np.array(terms_), np.array(tfs), weights, 1000, 10_000)
    units = [(0, 1), (2, 3)]
    for unit in units:
        block.add_pair(unit)
    least = block.pairs[(0, 1)][2] + 1
    paired, single = (block.search(units, least, 10, bounds) for bounds in (True, False))
    assert sorted(paired[0]) == sorted(single[0]) and paired[2] == 100 and single[2] > 900
