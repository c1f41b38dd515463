"""Nearest neighbours by largest inner product: vantage-point trees per shard with relaxed triangle-inequality pruning.

Vectors get one more coordinate that brings them all to the largest norm; queries get a zero there. Then the nearest by
Euclidean distance is the largest by inner product, and a metric tree applies. A node keeps a vantage point and the median
distance to it; a side is left out when the distance to the median exceeds FACTOR times the query's 20th distance so far.
Factor one leaves out only what can't hold a nearer vector (exact search); smaller factors leave out more.

Every vector is in the tree of one shard, drawn by a hash of its id. Trees are built once and written, one row each, of
bounded size. Every query is in one block; each shard meets each block in a group of its own, so queries, not vectors, are
replicated, and one small pass reads a tree for many queries. The best of all shards are then ranked per query.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import settle

#: Vectors in a shard and queries in a block, about; vectors in a leaf; the relaxation.
SHARD, BLOCK, LEAF, FACTOR = 8192, 8192, 256, 0.7


class Tree:
    """A vantage-point tree over rows of points (with the added coordinate)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)), np.random.default_rng(5))

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> tuple:
        if len(rows) <= self.leaf:
            return (rows,)
        vantage = self.points[rng.choice(rows)]
        away = np.sqrt(np.maximum(0.0, ((self.points[rows] - vantage) ** 2).sum(axis=1)))
        median = float(np.median(away))
        near = away <= median
        if near.all():  # more than half at the median: the nearer ones, or else any half
            near = away < median
            if not near.any():
                near = np.arange(len(rows)) < len(rows) // 2
        inner, outer = float(away[near].max()), float(away[~near].min())
        return vantage, inner, outer, self._build(rows[near], rng), self._build(rows[~near], rng)

    def search(self, queries: np.ndarray, k: int, factor: float = FACTOR) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the rows seen that may be among its k nearest, with squared distances (some more than k where they tie)."""
        best = np.full((len(queries), k), np.inf)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        norms = (queries**2).sum(axis=1)
        point_norms = (self.points**2).sum(axis=1)

        def visit(node: tuple, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 1:
                rows = node[0]
                gap = norms[who][:, None] + point_norms[rows] - 2 * queries[who] @ self.points[rows].T
                limit = best[who, -1] + 1e-9
                best[who] = np.sort(np.concatenate((best[who], gap), axis=1), axis=1)[:, :k]
                for i, q in enumerate(who):
                    inside = gap[i] <= min(limit[i], best[q, -1] + 1e-9)
                    if inside.any():
                        found[q].append((rows[inside], gap[i][inside]))
                return
            vantage, inner, outer, near, far = node
            away = np.sqrt(np.maximum(0.0, ((queries[who] - vantage) ** 2).sum(axis=1)))
            first = away <= (inner + outer) / 2
            visit(near, who[first])
            visit(far, who[~first])
            reach = factor * np.sqrt(np.maximum(0.0, best[who, -1]))
            visit(far, who[first & (outer - away <= reach)])
            reach = factor * np.sqrt(np.maximum(0.0, best[who, -1]))
            visit(near, who[~first & (away - inner <= reach)])

        visit(self.root, np.arange(len(queries)))
        out = []
        for parts, last in zip(found, best[:, -1], strict=True):
            rows = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, int)
            gaps = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
            out.append((rows[gaps <= last + 1e-9], gaps[gaps <= last + 1e-9]))
        return out


def _array(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _lift(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack((vectors, np.sqrt(np.maximum(0.0, top * top - (vectors**2).sum(axis=1)))))


def build(ids: np.ndarray, vectors: np.ndarray, top: float, k: int, leaf: int) -> bytes:
    """A shard's tree, written out. Equal vectors are one point, standing for its k + 1 smallest ids, all that can be asked for."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    points, member = np.unique(vectors, axis=0, return_inverse=True)
    by_point = np.argsort(member.reshape(-1), kind="stable")
    starts = np.searchsorted(member.reshape(-1)[by_point], np.arange(len(points) + 1))
    groups = [ids[by_point[a : min(b, a + k + 1)]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return pickle.dumps((points, groups, Tree(_lift(points, top), leaf)), protocol=5)


def answers(tree: bytes, query_ids: np.ndarray, asked: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """The k best of one shard for each query of a block."""
    points, groups, made = pickle.loads(tree)
    # the query itself is a candidate too, so one more is looked for
    found = made.search(np.column_stack((asked, np.zeros(len(asked)))), k + 1, factor)
    rows = []
    for query, vector, (at, _) in zip(query_ids, asked, found, strict=True):
        scores = (points[at] * vector).sum(axis=1)
        near = np.array([(-s, v) for s, p in zip(scores, at, strict=True) for v in groups[p] if v != query], dtype=[("s", float), ("v", np.int64)])
        rows += [(query, v, -s) for s, v in np.sort(near, order=["s", "v"])[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, every: int, k: int, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product with each query, nearest first.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by every; candidates all rows but those with
    the query's vec_id. Ties go to the smaller vec_id. Rows with a null vec_id or embedding, zero vectors and vectors with
    null or non-finite components take no part; vectors meet only those of their own length. Rows that repeat a vec_id with
    different vectors are several candidates, of which a query keeps the nearest; such a query is asked with the vector that
    comes first in order. With fewer candidates than k all are returned, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    good = plain.where(finite & F.exists("vector", lambda x: x != 0)).withColumns({"size": F.size("vector"), "norm": norm})
    kinds = good.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
    shards = F.ceil(F.col("n") / shard).cast("int")
    blocks = F.ceil(F.col("n") / (every * block)).cast("int")
    kinds = settle(kinds.select("size", "top", shards.alias("shards"), blocks.alias("blocks")), "kinds")
    placed = good.join(kinds, "size").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = build(frame["vec_id"].to_numpy(), _array(frame["vector"]), float(frame["top"].iloc[0]), k, leaf)
        return pd.DataFrame({"size": frame["size"].iloc[:1], "shard": frame["shard"].iloc[:1], "tree": [tree]})

    trees = settle(placed.select("size", "shard", "top", "vec_id", "vector").groupBy("size", "shard").applyInPandas(grow, "size int, shard int, tree binary"), "trees")
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id", "size", "shards", "blocks").agg(F.min("vector").alias("vector"))
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")
    queries = asked.withColumn("block", block_of).select("size", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "vec_id", "vector")
    held = trees.join(kinds.select("size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "size")

    def run(key: tuple, index: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(index) or not len(asks):
            return empty
        asks = asks.sort_values("vec_id")
        return pd.concat([empty, answers(index["tree"].iloc[0], asks["vec_id"].to_numpy(), _array(asks["vector"]), k, factor)])

    pair = ("size", "shard", "block")
    held, asks = (df.toDF(*df.columns) for df in (held, queries))  # names of their own for both sides
    found = held.groupBy(*pair).cogroup(asks.groupBy(*pair)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
