"""Exact top-k inner products by best-first search in a distributed M-tree.

Vectors are quantised to integers. An added coordinate gives all of them the same length, so that the largest inner
product is the smallest Euclidean distance, a metric. The tree has three levels: root entries, whose pivots are a
bounded sample; leaf pages of at most PAGE vectors with a pivot and a covering radius; and vectors. Pages keep their
distance to the root pivot and vectors their distance to the page's pivot, so that the triangle inequality rules them
out before a distance is computed. A query is sent only to the root entries that may hold one of its k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import bounded_sample, shuffle_parts, stage, table

#: Root pivots are at most MAX_PIVOTS, one for about NODE vectors; the sample, from which every query also gets its
#: first bound, is at most MAX_SAMPLE vectors.
NODE, MAX_PIVOTS, MAX_SAMPLE = 4096, 1024, 4096
PAGE = 256
#: Pages of a root entry that are searched together in a task; a larger entry is spread over several.
PAGES_AT_ONCE = 64
QUERIES_AT_ONCE = 256
#: Relative error that distances may have; bounds are widened by it, scores are exact integers.
SLACK = 1e-9
EXACT = float(1 << 52)


def quantised(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, q (array of double with whole values): floor(scale * x), without vectors that are null, empty or hold
    null or non-finite components, and without rows that have no id. Of rows with the same vec_id the least counts."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0))
    rows = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))
    return rows.groupBy("vec_id").agg(F.min("q").alias("q"))


def _matrix(arrays, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(arrays), width))
    for row, a in zip(out, arrays, strict=True):
        row[: len(a)] = a
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes their squared length `top`."""
    rest = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, rest])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _scores(x: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of the rows of x with q: in doubles where all sums stay whole, else in big integers."""
    if top * 1.0 < EXACT:
        return (x @ q).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in big], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


class _Tree:
    """What every task knows of the tree: the root pivots, the sample, the width and the common squared length."""

    def __init__(self, sample_ids, sample, pivots: int, top: float, k: int):
        self.ids, self.sample, self.top, self.k = sample_ids, sample, top, k
        self.width = sample.shape[1]
        self.pivots = _lifted(sample[:pivots], top)
        self.slack = SLACK * max(top, 1.0)

    def reach(self, q: np.ndarray, score: float) -> float:
        """The distance at which a vector has this inner product with q."""
        return float(np.sqrt(max(self.top + float(q @ q) - 2 * score + self.slack, 0.0)))


def _pages(tree: _Tree):
    """Packs the vectors of a task into pages, each below its nearest root pivot."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, x = batch["vec_id"].to_numpy(np.int64), _matrix(batch["q"], tree.width)
            lifted = _lifted(x, tree.top)
            far = _distances(lifted, tree.pivots)
            node = far.argmin(axis=1)
            rows = []
            for c in np.unique(node):
                mine = np.flatnonzero(node == c)
                mine = mine[np.argsort(far[mine, c], kind="stable")]
                for at in range(0, len(mine), PAGE):
                    part = mine[at : at + PAGE]
                    pivot = lifted[part[len(part) // 2]]
                    own = _distances(lifted[part], pivot[None, :])[:, 0]
                    up = float(np.linalg.norm(pivot - tree.pivots[c]))
                    rows.append((
                        int(c), int(ids[part[0]]), len(part), up, float(own.max()), pivot.tobytes(),
                        ids[part].tobytes(), x[part].tobytes(), own.tobytes(),
                    ))
            yield pd.DataFrame(rows, columns=["node", "first", "n", "up", "radius", "pivot", "ids", "vectors", "own"])
    return run


PAGE_SCHEMA = "node int, first long, n int, up double, radius double, pivot binary, ids binary, vectors binary, own binary"
WORK = "node int, part int, kind int, up double, radius double, pivot binary, ids binary, vectors binary, own binary"


def _route(tree: _Tree, radius: np.ndarray, parts: np.ndarray):
    """Sends each query, with the bound that the sample gives it, to the root entries that may hold a better vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, q = batch["vec_id"].to_numpy(np.int64), _matrix(batch["q"], tree.width)
            bound = np.full(len(ids), -np.inf)
            for i in range(len(ids)):
                scores = _scores(tree.sample[tree.ids != ids[i]], q[i], tree.top)
                if len(scores) >= tree.k:
                    bound[i] = np.partition(scores, len(scores) - tree.k)[len(scores) - tree.k]
            far = _distances(np.column_stack([q, np.zeros(len(q))]), tree.pivots)
            reach = np.array([tree.reach(v, b) if b > -np.inf else np.inf for v, b in zip(q, bound, strict=True)])
            rows = []
            for c in range(len(radius)):
                for mine in np.array_split(go := np.flatnonzero(far[:, c] - radius[c] <= reach), -(-len(go) // QUERIES_AT_ONCE) or 1):
                    if len(mine):
                        packed = (ids[mine].tobytes(), q[mine].tobytes(), bound[mine].tobytes())
                        rows += [(c, p, 1, 0.0, 0.0, b"", *packed) for p in range(parts[c])]
            yield pd.DataFrame(rows, columns=["node", "part", "kind", "up", "radius", "pivot", "ids", "vectors", "own"])
    return run


def _search(tree: _Tree, pages: list, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, node: int) -> pd.DataFrame:
    """The k best vectors of these pages for each query, as far as they reach its bound."""
    ups = np.array([p[0] for p in pages])
    radii = np.array([p[1] for p in pages])
    pivots = np.array([p[2] for p in pages])
    to_node = _distances(np.column_stack([q, np.zeros(len(q))]), tree.pivots[node : node + 1])[:, 0]
    found = []
    for i in range(len(ids)):
        reach = tree.reach(q[i], bound[i]) if bound[i] > -np.inf else np.inf
        left = np.flatnonzero(np.abs(to_node[i] - ups) - radii <= reach + SLACK)  # by stored distances alone
        lifted = np.append(q[i], 0.0)
        far = np.sqrt(((pivots[left] - lifted) ** 2).sum(axis=1))
        nearest = np.argsort(far - radii[left], kind="stable")
        scores, owners = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, 2
        while at < len(nearest):  # best first, some pages at a time
            some = [j for j in nearest[at : at + step] if far[j] - radii[left[j]] <= reach + SLACK]
            if not some:
                break
            at, step = at + step, 2 * step
            vectors, owner = [], []
            for j in some:
                _, _, _, page_ids, x, own = pages[left[j]]
                near = (np.abs(far[j] - own) <= reach + SLACK) & (page_ids != ids[i])
                vectors.append(x[near])
                owner.append(page_ids[near])
            x, owner = np.concatenate(vectors), np.concatenate(owner)
            scores, owners = np.concatenate([scores, _scores(x, q[i], tree.top)]), np.concatenate([owners, owner])
            keep = _best(scores, owners, tree.k)
            scores, owners = scores[keep], owners[keep]
            if len(scores) == tree.k:
                bound[i] = max(bound[i], float(scores[-1]))
                reach = tree.reach(q[i], bound[i])
        fine = scores >= bound[i]
        found.append((np.full(int(fine.sum()), ids[i]), owners[fine], scores[fine]))
    query, owner, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"query_id": query, "vec_id": owner, "score": score})


def _answer(tree: _Tree):
    """Rows sorted by node, part and kind: the pages of a part are held, then its queries stream past."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pages = None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.node, r.part) != key:
                    key, pages = (r.node, r.part), []
                ids = np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.vectors, np.float64).reshape(len(ids), tree.width)
                own = np.frombuffer(r.own, np.float64)
                if r.kind == 0:
                    pages.append((r.up, r.radius, np.frombuffer(r.pivot, np.float64), ids, x, own))
                elif pages:
                    yield _search(tree, pages, ids, x, own.copy(), r.node)
    return run


def top_k(embeddings: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every vector whose id is divisible by `query_every` the k largest
    integer inner products with the other vectors, ties to the smaller id; fewer if there are fewer.

    Vectors of different lengths are filled with zeros. Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do rows without an id. Of rows with the same id the least vector counts. Scores
    beyond a long are cut to it. Empty tables give no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    shards = shuffle_parts(spark)
    rows = stage(quantised(embeddings, scale), "vectors")
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square)).head()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = bounded_sample(rows, "vec_id", MAX_SAMPLE).toPandas()
    pivots = max(1, min(MAX_PIVOTS, n // NODE))
    tree = _Tree(sample["vec_id"].to_numpy(np.int64), _matrix(sample["q"], width), pivots, float(top), k)
    pages = stage(rows.mapInPandas(_pages(tree), PAGE_SCHEMA), "pages")
    directory = pages.groupBy("node").agg(F.max(F.col("up") + F.col("radius")).alias("r"), F.count(F.lit(1)).alias("n"))
    radius, parts = np.full(pivots, -np.inf), np.zeros(pivots, int)
    for r in directory.collect():
        radius[r["node"]], parts[r["node"]] = r["r"] * (1 + SLACK), -(-r["n"] // PAGES_AT_ONCE)
    spread = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("node") + 1)
    held = pages.select(
        "node", F.pmod(F.xxhash64("first"), spread).cast("int").alias("part"), F.lit(0).alias("kind"),
        "up", "radius", "pivot", "ids", "vectors", "own",
    )
    queries = rows.where(F.col("vec_id") % query_every == 0).mapInPandas(_route(tree, radius, parts), WORK)
    work = held.union(queries).repartition(shards, "node", "part").sortWithinPartitions("node", "part", "kind")
    near = work.mapInPandas(_answer(tree), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op4_top_vectors(spark, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every query vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
