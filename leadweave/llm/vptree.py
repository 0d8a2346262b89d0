"""Nearest neighbours by vantage-point trees, one per shard, with a tunable pruning of the triangle inequality.

Shards are the cells of vantage points that are drawn from a bounded sample: a vector belongs to its
nearest one, and a large cell is salted into shards of about `shard_rows` rows. Every shard builds a
tree: a vantage point parts its vectors at the median distance. A query first searches its own cell;
the distance it finds bounds what it can still gain, so of the other cells it visits only those whose
least possible distance, times `factor`, is within that bound. The same holds for a tree's branches.
Factor 1 restores exact search; a greater one prunes more and can miss.

A leaf is compared by one matrix product for all queries that reach it. Its rounding only decides which
pairs are looked at: those that may be among the nearest get their distance component by component.
Of equal vectors in a shard the k + 1 smallest ids stand for all, since no other can be among k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.tables import written

_FOUND = "query_id bigint, vec_id bigint, score double"
_NONE = np.iinfo(np.int64).max


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in double, summed component by component: row i of a with row i of b."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            out += d * d
    return np.sqrt(out)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a with all of b, with a small error; where it can't be told, nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.where(np.isfinite(out), np.maximum(out, 0), 0)


def _error(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No less than the error of squares(), for each row of a."""
    with np.errstate(over="ignore"):
        most = (a * a).sum(axis=1) + (b * b).sum(axis=1).max(initial=0)
    return np.where(np.isfinite(most), 1e-12 * most, np.inf)


class Tree:
    """A vantage-point tree over vectors in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 512, seed: int = 0):
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = self.vectors[rows[self.random.integers(len(rows))]]
        d = np.sqrt(squares(point[None], self.vectors[rows])[0])
        middle = float(np.median(d))
        inside = d <= middle
        if inside.all() or not inside.any():
            return rows  # all as far: nothing to part
        return point, middle, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of each query within its bound, itself excepted; _NONE for none."""
        best_id = np.full((len(ids), k), _NONE)
        best = np.full((len(ids), k), np.inf)

        def compare(node: np.ndarray, q: np.ndarray) -> None:
            mine, theirs = queries[q], self.vectors[node]
            d = squares(mine, theirs)
            d[ids[q][:, None] == self.ids[node][None, :]] = np.inf
            most = np.minimum(bound[q], best[q][:, -1]) ** 2
            if len(node) > k:
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
            row, at = np.nonzero((d <= (most * (1 + 1e-12) + 2 * _error(mine, theirs))[:, None]) & (d < np.inf))
            if not len(row):
                return
            # What these queries had and what is new, nearest first, then the smaller id.
            some, row = np.unique(row, return_inverse=True)
            score = np.concatenate([best[q[some]].ravel(), paired(mine[some[row]], theirs[at])])
            names = np.concatenate([best_id[q[some]].ravel(), self.ids[node[at]]])
            of = np.concatenate([np.repeat(np.arange(len(some)), k), row])
            order = np.lexsort((names, score, of))
            first = np.searchsorted(of[order], np.arange(len(some)))
            keep = order[first[:, None] + np.arange(k)]
            best[q[some]], best_id[q[some]] = score[keep], names[keep]

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                compare(node, q)
                return
            point, middle, inner, outer = node
            d = np.sqrt(squares(queries[q], point[None])[:, 0])
            first = d <= middle
            visit(inner, q[first])
            visit(outer, q[~first])
            slack = 1e-6 * (d + middle)  # the root of an error of 1e-12
            again = (np.abs(d - middle) - slack) * factor <= np.minimum(bound[q], best[q][:, -1])
            visit(outer, q[first & again])
            visit(inner, q[~first & again])

        visit(self.root, np.arange(len(ids)))
        return best_id, best


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int, factor: float) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    left = left.sort_values("vec_id", kind="stable")
    vectors = _matrix(left["v"]) + 0.0  # no negative zeros
    same = pd.Series([r.tobytes() for r in vectors])
    few = (same.groupby(same).cumcount() <= k).to_numpy()
    tree = Tree(left["vec_id"].to_numpy()[few], vectors[few])
    right = right.sort_values("query_id", kind="stable")
    ids = right["query_id"].to_numpy()
    found, score = tree.search(ids, _matrix(right["q"]), right["bound"].to_numpy(float), k, factor)
    keep = found.ravel() != _NONE
    return pd.DataFrame({"query_id": np.repeat(ids, k)[keep], "vec_id": found.ravel()[keep], "score": score.ravel()[keep]})


def nearest(
    df: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, shard_rows: int = 8_000, max_points: int = 1024, sample_rows: int = 4096,
    query_block: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id is divisible by `every`.

    Vectors that are null, empty, zero or hold a null or non-finite component, ids that are null, and
    vectors of another length than most have take no part. Of rows with one id the vector that sorts
    first counts. Ties go to the smaller id; with fewer candidates all are returned; an empty table
    gives no rows. Other columns are ignored, whatever their names. The vantage points come from
    `sample_rows` vectors, those with the least hash of their id; every row is indexed.
    """
    spark = df.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = (
        df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    )
    fine = written(fine.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, total = sizes["n"], sizes["count"]
    fine = fine.where(F.size("v") == width)
    sample = np.array([r["v"] for r in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()])  # sample_rows at most
    points = np.unique(sample[: min(max_points, max(1, total // shard_rows))], axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cell = squares(vectors, points).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(paired(vectors, points[cell]))], names=["vec_id", "v", "cell", "d"])

    placed = written(fine.mapInArrow(assign, "vec_id bigint, v array<double>, cell int, d double"), "cells")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("q")).collect()}  # max_points rows
    salts = {c: -(-r["n"] // shard_rows) for c, r in cells.items()}
    salt_of = F.element_at(F.create_map(*(F.lit(int(x)) for c in cells for x in (c, salts[c]))), F.col("cell"))
    blocks = max(1, -(-sum(r["q"] for r in cells.values()) // query_block))
    block = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")
    # Each shard is given to every block of queries; there is one block up to `query_block` queries.
    shards = placed.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), salt_of.cast("bigint")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell")

    def search(routed: DataFrame) -> DataFrame:
        spread = routed.withColumns({"salt": F.explode(F.sequence(F.lit(0), salt_of.cast("int") - 1)), "block": block})
        # A group is a shard (shard_rows on average) and the block's queries that are routed to it.
        return shards.groupBy("cell", "salt", "block").cogroup(spread.groupBy("cell", "salt", "block")).applyInPandas(lambda a, b: _search(a, b, k, factor), _FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    home = written(search(queries.withColumn("bound", F.lit(float("inf")))), "home")
    best = home.select("*", rank.alias("rank")).where(F.col("rank") <= k)
    bounds = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("bound"))
    names = np.array(sorted(cells))
    near, far = np.array([cells[c]["near"] for c in names]), np.array([cells[c]["far"] for c in names])
    gap = np.sqrt(squares(points, points[names]))  # max_points x max_points

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = np.sqrt(squares(_matrix(batch["q"]), points[names]))
            own = batch["cell"].to_numpy()
            # Of a cell's vectors: in the ring around its point, and on its side of the bisector.
            home_d = d[np.arange(len(d)), np.searchsorted(names, own)][:, None]
            least = np.maximum.reduce([d - far, near - d, (d * d - home_d * home_d) / np.maximum(2 * gap[own], 1e-300)])
            slack = 1e-6 * (d + far)
            go = ((least - slack) * factor <= batch["bound"].to_numpy()[:, None]) & (names[None] != own[:, None])
            q, c = np.nonzero(go)
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[q], "q": batch["q"].to_numpy()[q], "cell": names[c].astype("int32"), "bound": batch["bound"].to_numpy()[q]})

    routed = queries.join(bounds, "query_id", "left").fillna(float("inf"), ["bound"]).mapInPandas(route, "query_id bigint, q array<double>, cell int, bound double")
    every_one = home.unionByName(search(routed)) if len(cells) > 1 else home
    return every_one.select("*", rank.alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
