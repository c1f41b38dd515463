"""Exact search for the largest inner products by norm buckets.

Vectors are grouped by length into buckets whose norms lie within a factor of each other; a bucket is dealt out to cells of
bounded size by a hash of the id. Two rounds: the longest vectors are asked first, and the k-th best product that a query
finds there is its threshold from then on. A bucket whose greatest norm can't bring a product up to the threshold is left
out for that query. In a cell the threshold, divided by the norms, is a least cosine. Where it is low, only the norms prune
(the candidates are the longest vectors of the cell); where it is high, the coordinates prune: with a least cosine, each
coordinate of the vector's direction must lie in an interval around the query's own, so the interval that holds the
fewest vectors of the cell is looked up in a sorted list, and the others thin out what it gives. All candidates are then
verified by their whole products.

Both sides are replicated: a cell for each block of queries, a query for each cell that it still needs. Cells and blocks hold
CELL_VALUES numbers, so this is (vectors x queries) / (rows of a cell) rows in the worst case, where no norm prunes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import settle, small_enough

#: Norms of a bucket lie within this factor; numbers in a cell or block; vectors that the first round asks for, about.
RATIO, CELL_VALUES, FIRST = 1.05, 1 << 20, 4096
#: Rows of a cell between two looks at the thresholds, coordinates that prune, the least cosine from which they do.
SLICE, FOCUS, STEEP = 2048, 3, 0.5
#: Thresholds are lowered by this share, so that rounding never prunes what is just as good.
SLACK = 1e-9


def products(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products of all asked with all rows; sums beyond 64 bits become the largest or smallest of 64 bits."""
    if not asked.size or not rows.size:
        return np.zeros((len(asked), len(rows)), np.int64)
    wide = float(np.abs(asked.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max()) * asked.shape[1]
    if wide < 2.0**53:
        return (asked.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = asked.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _below(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles that are never above them."""
    return np.nextafter(scores.astype(np.float64), -np.inf)


class Cell:
    """Vectors of a bucket in descending order of norm, with sorted lists of the coordinates of their directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.directions = self.vectors / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        self.repeats = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.directions[:, f], kind="stable")
            self.lists[f] = order, self.directions[order, f]
        return self.lists[f]

    def near(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that may have this cosine with a direction, judged by the coordinates in which the direction is largest."""
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        own = direction[focus]
        spread = np.sqrt(np.maximum(0.0, (1 - cosine**2) * (1 - own**2)))
        low = np.where(own <= -cosine, -1.0, own * cosine - spread) - SLACK  # the cap around the direction may hold an end of the axis
        high = np.where(own >= cosine, 1.0, own * cosine + spread) + SLACK
        ranges = []
        for f, a, b in zip(focus, low, high, strict=True):
            values = self.by_coordinate(int(f))[1]
            ranges.append((int(np.searchsorted(values, a)), int(np.searchsorted(values, b, side="right"))))
        best = int(np.argmin([b - a for a, b in ranges]))
        rows = self.by_coordinate(int(focus[best]))[0][slice(*ranges[best])]
        for f, a, b in zip(focus, low, high, strict=True):
            values = self.directions[rows, f]
            rows = rows[(values >= a) & (values <= b)]
        return rows


class Best:
    """The k best (score, id) of each query so far, each id once, never the query's own; and the thresholds they give."""

    def __init__(self, query_ids: np.ndarray, k: int, thresholds: np.ndarray):
        self.query_ids, self.k, self.thresholds = query_ids, k, thresholds
        self.query, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        held = (ids != self.query_ids[query]) & (score >= self.thresholds[query])
        query, ids, score = (np.concatenate(pair) for pair in ((self.query, query[held]), (self.id, ids[held]), (self.score, score[held])))
        order = np.lexsort((~score, ids, query))  # ~x falls as x rises and never overflows
        query, ids, score = query[order], ids[order], score[order]
        first = np.concatenate(([True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])))[: len(query)]
        query, ids, score = query[first], ids[first], score[first]
        order = np.lexsort((ids, ~score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        inside = rank < self.k
        last = rank == self.k - 1
        self.thresholds[query[last]] = np.maximum(self.thresholds[query[last]], _below(score[last]))
        self.query, self.id, self.score = query[inside], ids[inside], score[inside]


def search(cell: Cell, query_ids: np.ndarray, asked: np.ndarray, thresholds: np.ndarray, k: int, size: int = SLICE, steep: float = STEEP) -> Best:
    """The k best of a cell for each query that reach its threshold (-inf: none is known)."""
    best = Best(query_ids, k, thresholds.copy())
    norms = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
    directions = asked / np.where(norms > 0, norms, 1.0)[:, None]
    by_rows = np.ones(len(asked), bool)  # queries that still go through the cell slice by slice
    for at in range(0, len(cell.ids), size):
        longest = cell.norms[at] * norms
        bound = best.thresholds - SLACK * (1 + np.abs(best.thresholds))
        by_rows &= longest * (1 + SLACK) >= bound  # norms only fall from here on
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(longest > 0, bound / longest, -1.0)
        for q in np.flatnonzero(by_rows & (cosine >= steep)):
            rows = cell.near(directions[q], min(1.0, float(cosine[q]) * (1 - SLACK)))
            rows = rows[rows >= at]
            best.add(np.full(len(rows), q), cell.ids[rows], products(asked[q : q + 1], cell.vectors[rows])[0])
            by_rows[q] = False  # that has settled all rows of the cell from here on
        who = np.flatnonzero(by_rows)
        if not len(who):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(norms[who] > 0, bound[who] / norms[who], -np.inf).min()
        stop = at + max(1, int(np.searchsorted(-cell.norms[at : at + size], -least * (1 - SLACK if least > 0 else 1 + SLACK), side="right")))
        found = products(asked[who], cell.vectors[at:stop])
        most = (k + 1) * cell.repeats  # so many rows hold k + 1 ids, one of which may be the query's own
        limit = np.partition(found, -most, axis=1)[:, -most] if found.shape[1] > most else np.full(len(who), -(2**63))
        query, row = np.nonzero((found >= limit[:, None]) & (found >= best.thresholds[who][:, None]))
        best.add(who[query], cell.ids[at + row], found[query, row])
    return best


def _numbers(table: pa.Table, name: str, size: int) -> np.ndarray:
    lists = table.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _meet(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(rows) or not len(asks):
            return _FOUND.empty_table()
        size = rows.column("size")[0].as_py()
        cell = Cell(rows.column("vec_id").to_numpy(), _numbers(rows, "vector", size))
        asks = asks.sort_by("vec_id")
        thresholds = np.array([-np.inf if t is None else _below(np.int64(t)) for t in asks.column("threshold").to_pylist()], np.float64)
        query_ids = asks.column("vec_id").to_numpy()
        best = search(cell, query_ids, _numbers(asks, "vector", size), thresholds, k)
        return pa.Table.from_arrays([pa.array(query_ids[best.query]), pa.array(best.id), pa.array(best.score)], schema=_FOUND)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, every: int, k: int, scale: int = 1024, cell_values: int = CELL_VALUES, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query, exactly, ties to the smaller vec_id.

    vectors: vec_id, embedding. Each component x counts as floor(scale * x), as a long (what lies beyond 64 bits as the
    nearest long). Queries are the rows whose vec_id is divisible by every; candidates all rows but those with the query's
    vec_id. Rows with a null vec_id or embedding or with null or non-finite components take no part; zero vectors do, with
    products of 0. Vectors meet only those of their own length. Repeated rows count once; of a vec_id with different vectors
    the largest product counts, and as a query it is asked with the vector that comes first in order. With fewer candidates
    than k all are returned, an empty table gives no rows, other columns are ignored.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = plain.where(finite).select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))
    norm: Column = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    good = whole.withColumns({"size": F.size("vector"), "norm": norm})
    good = good.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(RATIO))).cast("int")).otherwise(F.lit(-(2**31))))
    rows_of = F.greatest(F.lit(1), F.floor(F.lit(cell_values) / F.greatest("size", F.lit(1))))
    counts = good.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    longer = Window.partitionBy("size").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kinds = counts.withColumns({"cells": F.ceil(F.col("n") / rows_of).cast("int"), "opens": F.coalesce(F.sum("n").over(longer), F.lit(0)) < first})
    kinds = settle(kinds.withColumn("blocks", F.ceil(F.sum("asked").over(Window.partitionBy("size")) / rows_of).cast("int")), "buckets")
    cell = F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int")
    placed = good.drop("norm").join(small_enough(kinds.select("size", "bucket", "cells", "opens", "blocks")), ["size", "bucket"]).withColumn("cell", cell)
    placed = settle(placed.withColumn("opens", F.col("opens") & (F.col("cell") == 0)), "cells").where("blocks > 0")
    ask = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("size", "vector", "blocks")).alias("q")).select("vec_id", "q.*")
    ask = ask.withColumns({"block": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"), "norm": norm})
    needs = kinds.select("size", "bucket", "top", "opens", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    needs = needs.withColumn("opens", F.col("opens") & (F.col("cell") == 0))

    def meet(opens: bool, asked: DataFrame) -> DataFrame:
        rows = placed.where(F.col("opens") == opens).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("size", "bucket", "cell", "block", "vec_id", "vector")
        wanted = needs.where(F.col("opens") == opens).drop("opens")
        bound = F.col("threshold") - SLACK * (1 + F.abs("threshold"))
        reach = F.col("threshold").isNull() | (F.col("norm") * F.col("top") * (1 + SLACK) >= bound)
        asks = asked.join(small_enough(wanted), "size").where(reach).select("size", "bucket", "cell", "block", "vec_id", "vector", "threshold")
        left, right = (df.toDF(*df.columns).groupBy("size", "bucket", "cell", "block") for df in (rows, asks))
        return settle(left.cogroup(right).applyInArrow(_meet(k), "query_id long, vec_id long, score long"), "products")

    start = meet(True, ask.withColumn("threshold", F.lit(None).cast("long")))
    known = _best(start, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("threshold"))
    rest = meet(False, ask.join(known, "vec_id", "left"))
    return _best(start.union(rest), k).select("query_id", "rank", "vec_id", "score")
