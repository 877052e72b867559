"""Approximate nearest neighbours through low-dimensional stable projections.

Vectors are projected to M Gaussian directions, which makes the squared projected distance of a pair its
squared true distance times a chi-square variable of M degrees of freedom. A kd-tree over the projections
cuts them into cells (the table's partitions) and each cell into small leaves. A query goes through leaves
in the order of their projected distance and verifies true distances, and stops when the chi-square test
says that what is left holds a nearer vector with a chance below 1 - CONFIDENCE.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stockwell.llm.common import materialize

M = 6
CONFIDENCE = 0.98
#: Cells grow with the table, one for about CELL_ROWS vectors, up to MOST_CELLS; those of more than BLOCK_ROWS are searched in
#: blocks. The tree is fitted on the projections of about SAMPLE vectors a cell; every vector is indexed.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS, SAMPLE, LEAF = 512, 1 << 16, 4096, 16, 32
SEED = 11


def chi_square_quantile(p: float, m: int = M) -> float:
    """The value that a chi-square variable of m (even) degrees of freedom stays below with probability p."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid) < p else (lo, mid)
    return hi


def projection(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, M))


def split(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """A kd-tree as (order of the points, ends of its leaves in it, lower and upper corners of the leaves)."""
    order, ends, lows, highs = [], [], [], []
    todo = [np.arange(len(points))]
    while todo:
        ids = todo.pop()
        box = points[ids]
        lo, hi = box.min(0), box.max(0)
        axis = int((hi - lo).argmax())
        if len(ids) <= leaf or hi[axis] == lo[axis]:
            order.append(ids)
            ends.append(len(ids))
            lows.append(lo)
            highs.append(hi)
            continue
        half = len(ids) // 2
        part = np.argpartition(box[:, axis], half)
        todo += [ids[part[half:]], ids[part[:half]]]
    return np.concatenate(order), np.cumsum(ends).tolist(), np.array(lows), np.array(highs)


class Tree:
    """The upper kd-tree: median cuts of a sample, as arrays; cells are numbered from 0 and cover the space."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.cut, self.kids, self.lows, self.highs = [], [], [], [], []
        self.cells = 0
        self._grow(points, max(1, cells), np.full(M, -np.inf), np.full(M, np.inf))

    def _grow(self, points, cells, lo, hi) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.kids.append((self.cells, 0))
        spread = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(M)
        axis = int(spread.argmax())
        if cells < 2 or spread[axis] == 0:
            self.lows.append(lo)
            self.highs.append(hi)
            self.cells += 1
            return node
        cut = float(np.median(points[:, axis]))
        below = points[:, axis] < cut
        if not below.any():
            cut = float(points[:, axis][points[:, axis] > points[:, axis].min()].min())
            below = points[:, axis] < cut
        up, down = hi.copy(), lo.copy()
        up[axis], down[axis] = cut, cut
        self.axis[node], self.cut[node] = axis, cut
        left = self._grow(points[below], cells // 2, lo, up)
        self.kids[node] = (left, self._grow(points[~below], cells - cells // 2, down, hi))
        return node

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        axis, cut, kids = np.array(self.axis), np.array(self.cut), np.array(self.kids)
        at = np.zeros(len(points), np.int64)
        while (inner := axis[at] >= 0).any():
            right = points[np.arange(len(points)), np.maximum(axis[at], 0)] >= cut[at]
            at = np.where(inner, np.where(right, kids[at, 1], kids[at, 0]), at)
        return kids[at, 0]


def gaps(point: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    d = np.maximum(np.maximum(lows - point, point - highs), 0)
    return np.einsum("ij,ij->i", d, d)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col="vec_id", vector_col="embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of each query row, ties to the smaller vec_id.

    Every other usable row is a candidate: vectors that are null, empty, zero, of another length than the
    most frequent one, or hold a null, NaN or infinite component take no part, and neither do null ids.
    Equal vectors are searched as one and then answer with their smallest ids. Repeated ids are rows of
    their own; a query never finds a row of its own id. Fewer candidates: all of them. An empty table
    gives an empty result; other columns are ignored.
    """
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), e.alias("e"), is_query.alias("q")).where("vec_id is not null and e is not null and size(e) > 0")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = rows.where(fine)
    widths = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths is None:
        return empty
    dim = widths.n
    # -0.0 and 0.0 are equal numbers: adding 0.0 makes them equal bits as well.
    rows = rows.where(F.size("e") == dim).select("vec_id", F.transform("e", lambda x: x + F.lit(0.0)).alias("e"), "q")
    rows = materialize(rows.withColumn("h", F.md5(F.to_json("e").cast("binary"))), "ann-rows")
    # Of equal vectors a query needs k + 1 ids at most (its own may be one): ranked in salted groups first.
    some = rows.select("h", "vec_id").distinct()
    for by in (["h", F.pmod(F.xxhash64("vec_id"), F.lit(64))], ["h"]):
        some = some.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    ids = some.groupBy("h").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = rows.groupBy("h").agg(F.first("e").alias("e"))
    total = distinct.count()
    direction = projection(dim)
    cells = min(MOST_CELLS, max(1, total // CELL_ROWS))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(e: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(e) @ direction))

    some = distinct.where(F.pmod(F.xxhash64("h"), F.lit(max(1, total // (cells * SAMPLE)))) == 0)
    tree = Tree(_matrix(some.orderBy("h").select(project("e").alias("p")).toPandas()["p"]), cells)
    limit = chi_square_quantile(confidence)
    lows, highs = np.array(tree.lows), np.array(tree.highs)

    @F.pandas_udf(T.IntegerType())
    def cell(e: pd.Series) -> pd.Series:
        return pd.Series(tree.cell_of(_matrix(e) @ direction).astype(np.int32))

    found = materialize(distinct.join(ids, "h").withColumn("cell", cell("e")).select("h", "cell", "e", "ids"), "ann-cells")
    # One row per cell: bounded by MOST_CELLS.
    blocks = found.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    blocks = F.broadcast(materialize(blocks, "ann-blocks"))
    indexed = found.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).cast("int")).select("cell", "block", "e", "ids")
    # Equal queries are searched as one, for one neighbour more: each of them may be among what is found.
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), "h").distinct()
    asked = materialize(rows.where("q").groupBy("h").agg(F.first("e").alias("e")).withColumn("cell", cell("e")), "ann-queries")
    most = k + 1

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: queries with the distance they have reached so far; right: one block of a cell's vectors."""
        if not len(left) or not len(right):
            return pd.DataFrame({"h": np.zeros(0, object), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        own, ids = _matrix(right["e"]), right["ids"].tolist()
        points = own @ direction
        order, ends, leaf_lows, leaf_highs = split(points, LEAF)
        starts = [0, *ends[:-1]]
        out = []
        for q, e, reached in zip(left["h"], _matrix(left["e"]), left["reached"], strict=True):
            gap = gaps(e @ direction, leaf_lows, leaf_highs)
            best: list[tuple[float, int]] = []
            bound = reached
            for leaf in np.argsort(gap, kind="stable").tolist():
                if gap[leaf] > limit * bound * bound:
                    break
                some = order[starts[leaf] : ends[leaf]]
                diff = own[some] - e
                dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                near = np.flatnonzero(dist <= bound)
                if len(near):
                    best += [(float(dist[j]), int(i)) for j in near.tolist() for i in ids[some[j]]]
                    best = sorted(best)[:most]
                    if len(best) == most:
                        bound = min(bound, best[-1][0])
            out += [(q, i, d) for d, i in best]
        return pd.DataFrame(out, columns=["h", "vec_id", "score"]).astype({"vec_id": "int64", "score": "float64"})

    def meet(queries: DataFrame) -> DataFrame:
        queries = queries.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return queries.groupBy("cell", "block").cogroup(indexed.groupBy("cell", "block")).applyInPandas(visit, "h string, vec_id long, score double")

    first = materialize(meet(asked.withColumn("reached", F.lit(float("inf")))), "ann-first")
    reached = first.groupBy("h").agg(F.get(F.array_sort(F.collect_list("score")), F.lit(most - 1)).alias("reached"))

    def more(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for q, e, home, r in zip(pdf["h"], pdf["e"], pdf["cell"], pdf["reached"], strict=True):
                gap = gaps(np.asarray(e, np.float64) @ direction, lows, highs)
                to = np.flatnonzero(gap <= limit * r * r)
                to = to[to != home]
                if len(to):
                    yield pd.DataFrame({"h": q, "e": [e] * len(to), "cell": to.astype(np.int32), "reached": r})

    onward = asked.join(reached, "h", "left").withColumn("reached", F.coalesce("reached", F.lit(float("inf"))))
    onward = onward.select("h", "e", "cell", "reached").mapInPandas(more, "h string, e array<double>, cell int, reached double")
    best = first.unionByName(meet(onward)).distinct()
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("score", "vec_id"))).where(F.col("n") <= most).drop("n")
    own = queries.join(materialize(best, "ann-best"), "h").where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return own.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
