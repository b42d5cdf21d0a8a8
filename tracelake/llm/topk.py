"""Exact top-k inner products by a dual search of cover trees.

Queries and data are cut into blocks, and each block is put in a cover tree. Two trees are searched together: a pair of
nodes is dropped when the largest inner product that any of its vectors can have (from the centres, their norms and the
covering radii) is below the worst k-th score that all queries under the query node have already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import written


class CoverTree:
    """Nodes with a centre (a row of ``points``), a covering radius and either children or rows.

    Built from the top: a node of radius r takes centres that are over r / 2 apart, in order of their distance, until
    its rows are covered; every row goes to its nearest centre. Rows equal to their centre end the descent.
    """

    def __init__(self, points: np.ndarray, leaf: int = 256, fan: int = 16):
        self.points, self.leaf, self.fan = points, leaf, fan
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            middle = int(np.argmin(self._distances(np.arange(len(points)), points.mean(axis=0))))
            work = [(self._node(middle, np.arange(len(points))), np.arange(len(points)))]
            while work:
                node, rows = work.pop()
                if len(rows) <= leaf or self.radius[node] == 0:
                    self.rows[node] = rows
                    continue
                for center, part in self._split(node, rows):
                    child = self._node(center, part)
                    self.children[node].append(child)
                    work.append((child, part))

    def _distances(self, rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.points[rows] - center).sum(axis=1))

    def _node(self, center: int, rows: np.ndarray) -> int:
        self.center.append(center)
        self.radius.append(float(self._distances(rows, self.points[center]).max()))
        self.children.append([])
        self.rows.append(rows[:0])
        return len(self.center) - 1

    def _split(self, node: int, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        nearest = self._distances(rows, self.points[self.center[node]])
        centers, owner = [self.center[node]], np.zeros(len(rows), np.int64)
        # the farthest row becomes the next centre; distances to centres only fall
        while len(centers) < self.fan and nearest.max() > self.radius[node] / 2:
            far = int(np.argmax(nearest))
            distance = self._distances(rows, self.points[rows[far]])
            closer = distance < nearest
            owner[closer], nearest = len(centers), np.minimum(nearest, distance)
            centers.append(int(rows[far]))
        if len(centers) == 1:
            far = int(np.argmax(nearest))
            owner[self._distances(rows, self.points[rows[far]]) < nearest] = 1
            centers.append(int(rows[far]))
        return [(c, rows[owner == i]) for i, c in enumerate(centers) if (owner == i).any()]


def dual_search(queries: CoverTree, data: CoverTree, query_ids: np.ndarray, ids: np.ndarray, k: int):
    """The k best (score, id) of every query row, as arrays with -1 ids where there are fewer. Scores are exact: points
    are integers held as doubles. A row with the query's own id is no candidate; ties go to the smaller id."""
    best = np.full((len(query_ids), k), -np.inf)
    who = np.full((len(query_ids), k), np.iinfo(np.int64).max)
    if not len(query_ids) or not len(ids):
        return best, who
    norm_q = np.sqrt(np.square(queries.points).sum(axis=1))
    norm_d = np.sqrt(np.square(data.points).sum(axis=1))
    under = _rows_under(queries)

    def bound(q: int, d: int) -> float:
        a, b = queries.center[q], data.center[d]
        r, s = queries.radius[q], data.radius[d]
        return float(queries.points[a] @ data.points[b]) + norm_q[a] * s + norm_d[b] * r + r * s

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        most, q, d = stack.pop()
        # a tie may still win by its id, so only what is surely below is dropped
        if most + 1e-6 * (1 + abs(most)) < best[under[q], -1].min():
            continue
        if not queries.children[q] and not data.children[d]:
            _settle(queries.rows[q], data.rows[d], queries.points, data.points, query_ids, ids, best, who, k)
            continue
        if data.children[d] and (not queries.children[q] or data.radius[d] >= queries.radius[q]):
            pairs = [(q, c) for c in data.children[d]]
        else:
            pairs = [(c, d) for c in queries.children[q]]
        stack += sorted((bound(*p), *p) for p in pairs)  # the most promising pair is taken first
    return best, who


def _rows_under(tree: CoverTree) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(tree.center)
    for node in range(len(tree.center) - 1, -1, -1):
        parts = [out[c] for c in tree.children[node]]
        out[node] = np.concatenate(parts) if parts else tree.rows[node]
    return out


def _settle(q, d, query_points, points, query_ids, ids, best, who, k) -> None:
    scores = query_points[q] @ points[d].T
    scores[query_ids[q][:, None] == ids[d][None, :]] = -np.inf
    row, column = np.nonzero((scores >= best[q, -1][:, None]) & (scores > -np.inf))
    if not len(row):
        return
    touched = np.unique(row)
    row = np.concatenate([row, np.repeat(touched, k)])
    value = np.concatenate([scores[row[: len(column)], column], best[q[touched]].ravel()])
    name = np.concatenate([ids[d[column]], who[q[touched]].ravel()])
    order = np.lexsort((name, -value, row))
    row, value, name = row[order], value[order], name[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = place < k
    best[q[row[keep]], place[keep]] = value[keep]
    who[q[row[keep]], place[keep]] = name[keep]


def codes(embedding: Column) -> Column:
    """floor(256 * x) of every component x, as doubles; null where a vector is null or has a null or non-finite one."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * 256).cast("double")))


def search(
    rows: DataFrame, is_query: Column, k: int, id: str = "vec_id", embedding: str = "embedding", block: int = 4096
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the highest integer inner product for each query row.

    Vectors that are null or hold nulls or non-finite components, and rows without an id, take no part. Rows that repeat
    an id count once, with the smallest of their vectors. Vectors of another length than the query's are no candidates
    for it. Fewer candidates than ``k`` give fewer rows.

    Data and queries are dealt to blocks of about ``block`` rows by the hash of their id; every query block meets every
    data block once, in a task that holds just these two, and leaves ``k`` rows for each query.
    """
    vectors = rows.withColumn("__code", codes(F.col(embedding))).withColumn("__query", is_query)
    vectors = vectors.where(F.col("__code").isNotNull() & F.col(id).isNotNull())
    vectors = vectors.groupBy(F.col(id).cast("long").alias("vec_id")).agg(
        F.min("__code").alias("code"), F.max("__query").alias("is_query")
    )
    vectors = written(vectors.withColumn("width", F.size("code")), "vectors")
    counts = vectors.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    data_blocks, query_blocks = max(1, -(-counts[0] // block)), max(1, -(-counts[1] // block))
    hashed = F.xxhash64("vec_id")
    data = vectors.withColumn("d", F.pmod(hashed, F.lit(data_blocks)).cast("int"))
    data = data.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = vectors.where("is_query").withColumn("q", F.pmod(hashed, F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))))
    columns = ["q", "d", "width", "vec_id", "code"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(left) or not len(right):
            return empty
        ids, query_ids = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        if not left["width"].iloc[0]:
            a, b = np.zeros((len(left), 1)), np.zeros((len(right), 1))
        else:
            a, b = np.stack(left["code"].to_numpy()), np.stack(right["code"].to_numpy())
        best, who = dual_search(CoverTree(a), CoverTree(b), query_ids, ids, k)
        real = best > -np.inf
        return pd.DataFrame(
            {"query_id": np.repeat(query_ids, k)[real.ravel()], "vec_id": who[real], "score": best[real].astype(np.int64)}
        )

    keys = ["q", "d", "width"]
    found = (
        asked.select(columns)
        .groupBy(*keys)
        .cogroup(data.select(columns).groupBy(*keys))
        .applyInPandas(meet, "query_id long, vec_id long, score long")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
