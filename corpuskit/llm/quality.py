"""Quality by co-training: a classifier of the text and one of the metadata teach each other.

Both start from labelled documents. In every round each of them names the unlabelled documents that it is surest of,
and these join the other's training rows with the named label. In the end both views are calibrated on labelled rows
and combined, and every document is scored. Labelled rows are a bounded sample; the search for rows to teach with, what
they add to the fits, features and scores cover all documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import bounded_sample, released, stage, table
from corpuskit.llm.toxicity import labelled

#: Labelled rows that the classifiers are fitted on: those with the least hash of the id.
MAX_LABELLED = 12_000
ROUNDS, SHARE, SURE = 4, 0.05, 0.9
#: Levels of confidence for a unit of the logit; Newton steps of a fit, at most, and the step that ends it.
LEVELS, STEPS, TOLERANCE = 256, 30, 1e-4
SOURCES, LANGUAGES = 32, 8
MARKS = "!?.,;:'\"()[]{}<>*#$%&@|/\\-_+=~^`"
THRESHOLD = 0.5


def content_view(text: str) -> list[float]:
    """Shape of the text: letters, digits, marks, repetition of words, word pairs and lines."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256) / max(len(data), 1)
    lower = Counter(w.lower() for w in words)
    pairs = len(set(zip(words, words[1:])))
    lines = [line for line in text.split("\n") if line.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    sizes = np.array([len(w) for w in words] or [0])
    return [
        counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum(), counts[32], counts[10],
        *[counts[ord(m)] for m in MARKS],
        len(lower) / n, pairs / n, same / n, max(lower.values(), default=0) / n,
        len(set(lines)) / max(len(lines), 1), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        np.log1p(len(words)), len(words) / chars, float(sum(w[-1] in ".!?" for w in words)) / n,
        float(sum(w.isupper() for w in words)) / n, float(sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words)) / n,
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: float | None, text: str) -> list[float]:
    """Language, source, length and layout."""
    out = [0.0] * (SOURCES + LANGUAGES)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGUAGES] = 1.0
    lines = text.count("\n") + 1
    size = float(n_chars) if n_chars is not None and n_chars == n_chars else float(len(text))
    return [*out, np.log1p(max(size, 0.0)), np.log1p(lines), np.log1p(len(text) / lines), float(source is None), float(lang is None)]


def views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, label, content, metadata for every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", "held_out", "label"]].copy()
            out["doc_id"], out["label"] = out["doc_id"].astype("Int64"), out["label"].astype("Int32")
            texts = [t or "" for t in batch["text"]]
            out["content"] = [content_view(t) for t in texts]
            out["metadata"] = [
                metadata_view(a, b, c, t) for a, b, c, t in zip(batch["lang"], batch["source"], batch["n_chars"], texts, strict=True)
            ]
            yield out

    named = labelled(docs, labels, "quality", keep=("lang", "source", "n_chars"))
    rows = named.select("doc_id", "held_out", "label", "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return rows.mapInPandas(released(run), "doc_id long, held_out boolean, label int, content array<float>, metadata array<float>")


class Logistic:
    """A logistic law on standardised columns."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
        self.mean, self.scale, self.w = mean, scale, w

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + (self.columns(x) * self.w[1:]).sum(axis=1)  # row by row the same in any batch

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient and Hessian of the log-likelihood, without penalty, one after the other."""
        z = np.column_stack([np.ones(len(x)), self.columns(x)])
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return np.concatenate([z.T @ (weight * (y - p)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()])

    def step(self, sums: np.ndarray, strength: float = 1.0) -> bool:
        """One Newton step on the sums over all rows, L2-regularised; False if it is the last one needed."""
        d = len(self.w)
        penalty = strength * np.eye(d)
        penalty[0, 0] = 1e-3
        step = np.linalg.solve(sums[d:].reshape(d, d) + penalty, sums[:d] - penalty @ self.w)
        self.w = self.w + np.clip(step, -2, 2)
        return bool(np.abs(step).max() >= TOLERANCE)


def fit(x: np.ndarray, y: np.ndarray, each: float = 1.0, balanced: bool = True) -> Logistic:
    """The law of local rows that count `each`; with `balanced` both classes weigh alike."""
    model = Logistic(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(x.shape[1] + 1))
    weight = each * (class_weights(len(y), y.sum())[y.astype(int)] if balanced else np.ones(len(y)))
    for _ in range(STEPS):
        if not model.step(model.sums(x, y, weight)):
            break
    return model


def class_weights(n: float, ones: float) -> np.ndarray:
    """Weights of the classes 0 and 1 that make them weigh alike."""
    return np.array([n / (2 * (n - ones)), n / (2 * ones)]) if 0 < ones < n else np.ones(2)


class Run:
    """One co-training: its labelled rows, the models of both views, and the rounds so far as (models, least levels).

    A round's models and least levels say which rows it took, so a scan can tell that again and no state is kept for
    a row.
    """

    def __init__(self, known: list[np.ndarray], y: np.ndarray, each: float):
        self.known, self.y, self.each = known, y, each
        self.models = [fit(x, y, each) for x in known]
        self.rounds: list[tuple[list[Logistic], list[float]]] = []


def _levels(logit: np.ndarray) -> np.ndarray:
    """Confidence in steps of 1 / LEVELS of the logit, -1 below SURE."""
    size = np.abs(logit)
    return np.where(size >= math.log(SURE / (1 - SURE)), np.floor(size * LEVELS), -1)


def _replay(rounds: list, x: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows no round took, and for each view the label that the other one gave a row, -1 without."""
    free, given = np.ones(len(x[0]), bool), [np.full(len(x[0]), -1) for _ in x]
    for models, least in rounds:
        taken = np.zeros(len(free), bool)
        for teacher, pupil in ((0, 1), (1, 0)):
            logit = models[teacher].logit(x[teacher])
            named = free & (_levels(logit) >= least[teacher])
            given[pupil][named] = logit[named] > 0
            taken |= named
        free &= ~taken
    return free, given


def _scan(pool: DataFrame, summed: Callable[[Iterator[list[np.ndarray]]], pa.RecordBatch], schema: str) -> DataFrame:
    """`summed` over the batches of each task, as pairs of arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = (
            [b.column(v).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float) for v in ("content", "metadata")]
            for b in batches if b.num_rows
        )
        yield summed(arrays)

    return pool.mapInArrow(released(run), schema)


def _choose(pool: DataFrame, runs: list[Run]) -> bool:
    """Adds a round to every run: of all free rows the SHARE that each view is surest of; False if there are none.

    The choice is made on a histogram of confidence over all rows. Rows as sure as the last one chosen are chosen too.
    """
    state = [(r.models, r.rounds) for r in runs]

    def summed(batches: Iterator[list[np.ndarray]]) -> pa.RecordBatch:
        found: Counter = Counter()
        for x in batches:
            for k, (models, rounds) in enumerate(state):
                free, _ = _replay(rounds, x)
                found[(k, -1, 0.0)] += int(free.sum())
                for view in (0, 1):
                    levels, n = np.unique(_levels(models[view].logit(x[view][free])), return_counts=True)
                    found.update({(k, view, level): m for level, m in zip(levels.tolist(), n.tolist(), strict=True) if level >= 0})
        columns = [[k[i] for k in found] for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip((*columns, list(found.values())), (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)],
            ["run", "view", "level", "n"],
        )

    counted = _scan(pool, summed, "run int, view int, level double, n long")
    counts = counted.groupBy("run", "view", "level").agg(F.sum("n").alias("n")).toPandas()
    some = False
    for k, run in enumerate(runs):
        own = counts[counts["run"] == k]
        most = max(1, int(SHARE * own.loc[own["view"] == -1, "n"].sum()))
        least = []
        for view in (0, 1):
            bins = own[own["view"] == view].sort_values("level", ascending=False)
            reached = np.flatnonzero(bins["n"].cumsum().to_numpy() >= most)
            upto = reached[0] if len(reached) else len(bins) - 1
            least.append(float(bins["level"].iloc[upto]) if len(bins) else math.inf)
        run.rounds.append((run.models, least))
        some |= any(x < math.inf for x in least)
    return some


def _sums(pool: DataFrame, runs: list[Run], jobs: list[tuple[int, int]], one) -> list[np.ndarray]:
    """`one(job, x, y)` summed over the rows that were given a label, for each job (run, view); a task gives one row."""
    rounds = [r.rounds for r in runs]

    def summed(batches: Iterator[list[np.ndarray]]) -> pa.RecordBatch:
        total: dict[tuple[int, int], np.ndarray] = {}
        for x in batches:
            for k in sorted({k for k, _ in jobs}):
                _, given = _replay(rounds[k], x)
                for view in (v for run, v in jobs if run == k):
                    mine = given[view] >= 0
                    if mine.any():
                        total[k, view] = total.get((k, view), 0) + one((k, view), x[view][mine], given[view][mine].astype(float))
        columns = [[k for k, _ in total], [v for _, v in total], [v.tobytes() for v in total.values()]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["run", "view", "sums"]
        )

    out: dict[tuple[int, int], np.ndarray] = {}
    for row in _scan(pool, summed, "run int, view int, sums binary").collect():
        out[row["run"], row["view"]] = out.get((row["run"], row["view"]), 0) + np.frombuffer(row["sums"], float)
    return [out.get(job, 0) for job in jobs]


def _refit(pool: DataFrame, runs: list[Run]) -> None:
    """The models of all runs and views on the labelled rows and every row that a round has named so far."""
    jobs = [(k, view) for k in range(len(runs)) for view in (0, 1)]
    shift = {(k, v): runs[k].known[v].mean(axis=0) for k, v in jobs}

    def moments(job: tuple[int, int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        moved = x - shift[job]
        return np.concatenate([[len(y), y.sum()], moved.sum(axis=0), (moved * moved).sum(axis=0)])

    models, weights = {}, {}
    for job, more in zip(jobs, _sums(pool, runs, jobs, moments), strict=True):
        run = runs[job[0]]
        total = run.each * moments(job, run.known[job[1]], run.y) + more
        one, two = np.split(total[2:] / total[0], 2)
        scale = np.sqrt(np.maximum(two - one * one, 0)) + 1e-6
        weights[job] = class_weights(total[0], total[1])
        models[job] = Logistic(shift[job] + one, scale, np.zeros(len(scale) + 1))
    active = jobs
    for _ in range(STEPS):
        now = {job: models[job] for job in active}
        slope = lambda job, x, y: now[job].sums(x, y, weights[job][y.astype(int)])  # noqa: E731, B023
        more = dict(zip(active, _sums(pool, runs, active, slope), strict=True))
        own = {(k, v): runs[k].each * slope((k, v), runs[k].known[v], runs[k].y) for k, v in active}
        active = [job for job in active if models[job].step(own[job] + more[job])]
        if not active:
            break
    for k, run in enumerate(runs):
        run.models = [models[k, 0], models[k, 1]]


def co_train(known: list[np.ndarray], y: np.ndarray, pool: DataFrame, each: float = 1.0) -> tuple[list[Logistic], Logistic]:
    """The two views' classifiers and the calibrated combination of their logits.

    `known` are the labelled rows' views, each of them stands for `each` rows; `pool` has the columns content and
    metadata of all rows without a label. The combination is fitted on every second labelled row, which the
    classifiers of that fit have not seen.
    """
    every = np.arange(len(y))
    even = every[every % 2 == 0] if len(np.unique(y[::2])) == 2 else every
    runs = [Run([v[rows] for v in known], y[rows], each) for rows in (every, even)]
    for _ in range(ROUNDS):
        if not _choose(pool, runs):
            break
        _refit(pool, runs)
    seen = every[1::2] if len(np.unique(y[1::2])) == 2 else every
    logits = np.column_stack([m.logit(v[seen]) for m, v in zip(runs[1].models, known, strict=True)])
    return runs[0].models, fit(logits, y[seen], balanced=False)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, content_score, metadata_score for every row.

    score (0 to 1) is the likelihood of quality 1, predicted is 1 from THRESHOLD on. Rows whose crc32 of the id leaves
    1 modulo 3 are never learned from, neither with a label nor as pool. Null texts are empty, missing metadata is a
    value of its own. Without labels of both kinds every score is the mean label, or 0.5 without any. Equal rows have
    equal scores; an empty table gives no rows; other columns are ignored.
    """
    rows = stage(views(docs, labels), "views")
    named = rows.where("label IS NOT NULL")
    known = bounded_sample(named, "doc_id", MAX_LABELLED).toPandas()
    y = known["label"].to_numpy(float)
    model = None
    if len(np.unique(y)) == 2:
        pool = stage(rows.where("label IS NULL AND NOT held_out").select("content", "metadata"), "pool")
        sets = [np.stack(known[v].tolist()).astype(float) for v in ("content", "metadata")]
        model = co_train(sets, y, pool, named.count() / len(known))
    base = float(y.mean()) if len(y) else 0.5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squash = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        for batch in batches:
            out = batch[["doc_id", "held_out"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            scores = [np.full(len(batch), base)] * 3
            if model and len(batch):
                logits = [m.logit(np.stack(batch[v].tolist()).astype(float)) for m, v in zip(model[0], ("content", "metadata"), strict=True)]
                scores = [squash(model[1].logit(np.column_stack(logits))), *map(squash, logits)]
            out["score"], out["content_score"], out["metadata_score"] = scores
            out["predicted"] = (scores[0] >= THRESHOLD).astype(np.int32)
            yield out[["doc_id", "held_out", "score", "predicted", "content_score", "metadata_score"]]

    schema = "doc_id long, held_out boolean, score double, predicted int, content_score double, metadata_score double"
    return rows.select("doc_id", "held_out", "content", "metadata").mapInPandas(released(run), schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, and the views' scores."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
