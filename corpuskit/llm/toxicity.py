"""Toxicity by maximum-scoring segments of token log-odds with Dirichlet priors.

Words get log-odds of toxic against clean documents, smoothed by a Dirichlet prior from all documents. One linear
scan finds every maximal segment of positive score; a Karlin-Altschul extreme-value law turns a segment's score and
the document's length into an expected number of chance segments, whose logarithms add up to the document's
evidence. The evidence is calibrated on all training rows through a histogram.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import held_out, released, stage, table, text_tag

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of a word that are counted beside the word, so that unseen forms of a stem are recognised.
STEMS = (4, 5)
PRIOR = 5.0
#: A feature is evidence if its log-odds are this high and its likelihood ratio would not be expected by chance among
#: all features; any other token costs DRIFT.
MIN_SCORE = 2.0
DRIFT = 0.5
#: Size bound of the broadcast model: the features with the highest z.
MAX_FEATURES = 50_000
#: Labels are broadcast up to this many rows (16 bytes each); beyond, they are joined by exchange.
BROADCAST_LABELS = 2_000_000
#: Features that a task counts, or words that it remembers, before it starts anew.
FLUSH = 150_000
THRESHOLD = 0.7
#: Without a significant passage, the best segment's log-odds against chance, down to minus this, are told apart by
#: an evidence from -1 to 0.
CHANCE = 8.0


def _features(words: set[str]) -> set[str]:
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with a feature, partly added up: all, clean and toxic training rows."""
    whole, clean, toxic = Counter(), Counter(), Counter()

    def flush() -> pd.DataFrame:
        names = list(whole)
        out = pd.DataFrame({
            "feature": names, "whole": [whole[w] for w in names],
            "clean": [clean[w] for w in names], "toxic": [toxic[w] for w in names],
        })
        for c in (whole, clean, toxic):
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            found = _features(set(WORD.findall((text or "").lower())))
            whole.update(found)
            if label == 0:
                clean.update(found)
            elif label == 1:
                toxic.update(found)
            if len(whole) > FLUSH:
                yield flush()
    if whole:
        yield flush()


def labelled(docs: DataFrame, labels: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, tag and the columns `keep`, with held_out and label: the 0/1 of `column`, null in the held-out fold
    and without a label.

    Of several labels of an id the largest counts; other values than 0 and 1 are no labels.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(column).cast("int").alias("label"))
        .where("label IN (0, 1) AND l_id IS NOT NULL")
        .groupBy("l_id").agg(F.max("label").alias("label"))
    )
    known = stage(known.where(~held_out("l_id")), "labels")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_tag().alias("tag"), *keep).withColumn("held_out", held_out())
    return own.join(known, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")


def fit_log_odds(rows: DataFrame) -> tuple[dict[str, float], tuple[float, float]]:
    """The significant features' log-odds, and the extreme-value law of their segments in clean documents.

    `rows` has text and label. Without labels of both kinds the model is empty.
    """
    counts = rows.select("text", "label").mapInPandas(released(_count), "feature string, whole long, clean long, toxic long")
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("whole", "clean", "toxic")])
    sizes = rows.agg(
        F.count(F.lit(1)), F.sum((F.col("label") == 0).cast("long")), F.sum((F.col("label") == 1).cast("long"))
    ).head()
    n, n_clean, n_toxic = (float(x or 0) for x in sizes)
    if not n_clean or not n_toxic:
        return {}, (1.0, 0.5)
    share = PRIOR * F.col("whole") / n + 0.01
    clean, toxic = F.col("clean") + share, F.col("toxic") + share
    log_odds = F.log(toxic / (n_toxic + PRIOR - F.col("toxic"))) - F.log(clean / (n_clean + PRIOR - F.col("clean")))
    rate = n_toxic / (n_toxic + n_clean)
    seen = F.col("clean") + F.col("toxic")
    ratio = F.col("toxic") * F.log(F.col("toxic") / seen / rate) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / (1 - rate))
    ).otherwise(0.0)
    counts = stage(counts.where("clean + toxic > 0"), "word-counts")
    n_features, tokens = counts.agg(
        F.count(F.lit(1)), F.sum(F.when(F.col("feature").endswith("*"), F.lit(0)).otherwise(F.col("clean")))
    ).head()
    strong = (
        counts.select("feature", "clean", log_odds.alias("score"), (2 * ratio).alias("ratio"))
        .where((F.col("score") >= MIN_SCORE) & (F.col("ratio") >= 2 * math.log(max(n_features, 2))))
        .orderBy(F.desc("ratio"), "feature")
        .limit(MAX_FEATURES)
        .toPandas()
    )
    chance = (strong["clean"].to_numpy(float) + 0.1) / max(float(tokens or 0), 1.0)
    scores = strong["score"].to_numpy(float)
    return dict(zip(strong["feature"], scores.tolist(), strict=True)), extreme_value(scores, chance)


def extreme_value(scores: np.ndarray, chance: np.ndarray) -> tuple[float, float]:
    """Karlin-Altschul's lambda and K for clean tokens that are worth each of `scores` by `chance`, else -DRIFT.

    lambda is the positive root of mean(exp(lambda * score)) = 1, searched up to 2; K is 1 - exp(-lambda * DRIFT).
    """
    chance = chance * min(1.0, 0.2 / max(chance.sum(), 1e-12))
    low, high = 1e-3, 2.0
    for _ in range(60):
        mid = (low + high) / 2
        mean = (chance * np.exp(mid * scores)).sum() + (1 - chance.sum()) * math.exp(-mid * DRIFT)
        low, high = (mid, high) if mean < 1 else (low, mid)
    return low, 1 - math.exp(-low * DRIFT)


def maximal_segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), where `hits` are the positive tokens in order
    and every token between them costs DRIFT. Each segment is pushed and merged at most once."""
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    at, total = -1, 0.0
    for pos, score in hits:
        total -= DRIFT * (pos - at - 1)
        before, total, at = total, total + score, pos
        left, right, first = before, total, pos
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, right, first, pos))
    return [(first, last, right - left) for left, right, first, last in stack]


def evidence(rows: DataFrame, model: dict[str, float], law: tuple[float, float]) -> DataFrame:
    """`rows` (doc_id, tag, held_out, label, text) with evidence, passages and first and last token of the best passage."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    lam, k = law

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        seen: dict[str, float] = {}

        def score(word: str) -> float:
            if len(seen) > FLUSH:
                seen.clear()
            names = [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]
            seen[word] = best = max(known.get(name, 0.0) for name in names)
            return best

        for batch in batches:
            found = []
            for text in batch["text"]:
                words = WORD.findall((text or "").lower())
                values = [seen[w] if w in seen else score(w) for w in words]
                segments = maximal_segments([(i, v) for i, v in enumerate(values) if v > 0])
                scored = [(lam * s - math.log(k * len(words)), a, b) for a, b, s in segments]
                best = max(scored, default=(-CHANCE, None, None))
                scored = [x for x in scored if x[0] > 0]
                value = sum(x[0] for x in scored) if scored else max(best[0] / CHANCE, -1.0)
                first, last = best[1:] if scored else (None, None)
                found.append((value, len(scored), first, last))
            out = batch[["doc_id", "tag", "held_out", "label"]].copy()
            out["doc_id"], out["label"] = out["doc_id"].astype("Int64"), out["label"].astype("Int32")
            for i, name in enumerate(("evidence", "passages", "first_token", "last_token")):
                out[name] = pd.array([f[i] for f in found], dtype="Float64" if i == 0 else "Int64")
            yield out

    schema = "doc_id long, tag long, held_out boolean, label int, evidence double, passages long, first_token long, last_token long"
    return rows.select("doc_id", "tag", "held_out", "label", "text").mapInPandas(released(run), schema)


def calibrate(scored: DataFrame, step: float = 0.25, top: float = 50.0) -> tuple[float, float]:
    """Slope and offset of the logistic law of label 1 by evidence, from a histogram of all training rows.

    The slope is positive, so that more evidence never lowers a score.
    """
    level = F.least(F.col("evidence"), F.lit(top)) / step
    bins = scored.where("label IS NOT NULL").groupBy(F.round(level).cast("long").alias("level")).agg(
        F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")
    ).toPandas()
    x, ones, n = (bins[c].to_numpy(float) for c in ("level", "ones", "n"))
    x = np.minimum(x * step, 10.0)
    weight = np.array([-2.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(weight[0] + weight[1] * x, -30, 30)))
        grad = np.array([(ones - n * p).sum(), ((ones - n * p) * x).sum()]) - 0.05 * weight
        w = n * p * (1 - p)
        hess = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + 0.05 * np.eye(2)
        weight = weight + np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(float(weight[1]), 0.01), float(weight[0])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tag, held_out, score, predicted, evidence, passages, first_token, last_token for every row of `docs`.

    tag is the hash of the text, which tells rows with the same id or none apart.
    Rows whose crc32 of the id leaves 1 modulo 3 are never learned from. Only the text enters a score. Empty and null
    texts have no evidence and the score of none. Without labels of both kinds, every score is that of no evidence.
    Tokens are counted from zero. Equal texts have equal scores; repeated rows give repeated results, an empty
    table none; other columns are ignored.
    """
    rows = labelled(docs, labels, "toxic")
    model, law = fit_log_odds(rows)
    scored = stage(evidence(rows, model, law), "evidence")
    slope, offset = calibrate(scored)
    score = 1 / (1 + F.exp(-(F.lit(offset) + slope * F.least("evidence", F.lit(10.0)))))
    score = score + (1 - score) * (1 - F.exp(-F.greatest(F.col("evidence") - 10, F.lit(0.0)) / 1000)) / 2
    scored = scored.withColumn("score", score)
    return scored.select(
        "doc_id", "tag", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence", "passages", "first_token", "last_token",
    )


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, and its passages."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tag")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, with their own columns."""
    gone = score_toxicity(docs, labels).where("predicted = 1").select("doc_id", "tag").distinct().alias("gone")
    tagged = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("own_id"), text_tag().alias("own_tag"))
    same = F.col("own_id").eqNullSafe(F.col("gone.doc_id")) & (F.col("own_tag") == F.col("gone.tag"))
    return tagged.join(gone, same, "left_anti").select("own.*")
