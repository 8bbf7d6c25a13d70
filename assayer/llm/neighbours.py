"""Approximate nearest neighbours over low-dimensional stable projections in a kd-tree.

Vectors are projected to PROJECTED dimensions by a fixed Gaussian matrix; for two vectors
at distance d, the squared distance of their projections over d^2 follows a chi-square law
with as many degrees of freedom. Rows are dealt out in blocks, each of which builds a
kd-tree over its projections. A query takes the tree's leaves in the order of their
distance to its projection, verifies what they hold on the original vectors in double
precision, and stops when all that is left is so far away in the projection that a nearer
vector would have shown up before with probability CONFIDENCE (Sun et al., SRS).
The ten nearest of each block are then ranked for each query.

The queries are a stated set (vec_id divisible by EVERY); they go to every block, in
parts of at most QUERIES_AT_ONCE. Blocks hold about BLOCK_ROWS rows whatever the size of
the table. Equal vectors of a block are one point of its tree, with all their ids.

Defined cases: vectors that are null, zero, of another length than most vectors, or with null or non-finite components take no part, as queries or candidates;
ties go to the smaller vec_id; a query gets all candidates if there are fewer than TOP; a
vec_id that occurs several times is one query a row and never its own candidate, and equal
query rows are searched once and get equal results, one set each; an empty
table gives no rows; columns of the input other than the two named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVERY, TOP = 100, 10
PROJECTED, SEED = 8, 42
CONFIDENCE = 0.95
BLOCK_ROWS = 32_768
LEAF = 64
#: As many as BLOCK_ROWS: queries are 1 in 100, so sending parts to blocks and blocks to parts cost about the same.
QUERIES_AT_ONCE = 32_768


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def least_ratio() -> float:
    """The squared projected distance over the squared distance at which a search stops."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(np.array(mid), PROJECTED) < CONFIDENCE else (low, mid)
    return high


class KdTree:
    """Leaves of a kd-tree: halves along the widest dimension until LEAF points are left."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            part = points[rows]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            cut = len(rows) // 2
            order = np.argpartition(part[:, axis], cut)
            todo += [rows[order[:cut]], rows[order[cut:]]]
        self.leaves = leaves
        self.low = np.array([points[r].min(0) for r in leaves])
        self.high = np.array([points[r].max(0) for r in leaves])

    def nearest_first(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the squared distance of their box to the point, and these distances."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        d = (gap * gap).sum(1)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def search(tree: KdTree, points: np.ndarray, vectors: np.ndarray, query: np.ndarray, projected: np.ndarray, ratio: float, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows verified before the stop, and their squared distances; at least `enough` if there are.

    Points of opened leaves wait until their own projected distance is the next one.
    """
    order, bounds = tree.nearest_first(projected)
    bounds = np.append(bounds, np.inf)
    rows, dists = np.zeros(0, np.int64), np.zeros(0)
    waiting, far = np.zeros(0, np.int64), np.zeros(0)
    worst, i, step = np.inf, 0, 4
    while True:
        reach = min(bounds[i], ratio * worst)
        now = far <= reach
        if now.any():
            batch = waiting[now]
            waiting, far = waiting[~now], far[~now]
            diff = vectors[batch] - query
            rows, dists = np.concatenate((rows, batch)), np.concatenate((dists, np.einsum("ij,ij->i", diff, diff)))
            if len(rows) >= enough:
                worst = np.partition(dists, enough - 1)[enough - 1]
            continue
        if i >= len(order) or bounds[i] > ratio * worst:
            return rows, dists
        opened = np.concatenate([tree.leaves[k] for k in order[i : i + step]])
        i = min(i + step, len(order))
        gap = points[opened] - projected
        waiting, far = np.concatenate((waiting, opened)), np.concatenate((far, np.einsum("ij,ij->i", gap, gap)))


def _usable(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array([v is not None and len(v) == width and bool(np.isfinite(x := np.asarray(v, float)).all() and x.any()) for v in vectors], bool)


def _searched(data: pd.DataFrame, queries: pd.DataFrame, width: int, ratio: float) -> pd.DataFrame:
    """The nearest of a block for each query."""
    none = pd.DataFrame({"query_id": [], "query_key": [], "copies": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_key": "int64", "copies": "int64", "vec_id": "int64", "score": "float64"})
    data, queries = data[_usable(data["vector"], width)], queries[_usable(queries["vector"], width)]
    if data.empty or queries.empty:
        return none
    everything = np.stack(data["vector"].to_list()).astype(float)
    ids = data["vec_id"].to_numpy()
    by_id = np.argsort(ids, kind="stable")
    everything, ids = everything[by_id], ids[by_id]
    vectors, kind = np.unique(everything, axis=0, return_inverse=True)
    sizes = np.bincount(kind)
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(sizes)[:-1])
    matrix = np.random.default_rng(SEED).standard_normal((width, PROJECTED))
    points = vectors @ matrix
    tree = KdTree(points)
    out = []
    for query_id, key, copies, q in zip(queries["vec_id"], queries["query_key"], queries["copies"], np.stack(queries["vector"].to_list()).astype(float), strict=True):
        # Points that hold no rows but the query's own count neither as found nor as enough.
        own, n = np.unique(kind[np.searchsorted(ids, query_id) : np.searchsorted(ids, query_id, side="right")], return_counts=True)
        own = own[n == sizes[own]]
        rows, d = search(tree, points, vectors, q, q @ matrix, ratio, TOP + max(1, len(own)))
        others = ~np.isin(rows, own)
        rows, d = rows[others], d[others]
        if not len(rows):
            continue
        near = np.argsort(d, kind="stable")[:TOP]
        last = d[near[-1]]
        near = np.flatnonzero(d <= last)
        near = near[np.argsort(d[near], kind="stable")]
        same = [m[ids[m] != query_id][:TOP] for m in (members[rows[r]] for r in near)]
        found, dist = np.concatenate(same), np.repeat(np.sqrt(d[near]), [len(m) for m in same])
        best = np.lexsort((ids[found], dist))[:TOP]
        out.append(pd.DataFrame({"query_id": query_id, "query_key": key, "copies": copies, "vec_id": ids[found[best]], "score": dist[best]}))
    return pd.concat(out) if out else none


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest rows found for every query."""
    rows = df.select(df[key].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    count = rows.select("vec_id").count()
    first = rows.select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    width = first["n"] if first else 0
    blocks = max(1, -(-count // BLOCK_ROWS))
    ratio = least_ratio()
    data = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    queries = rows.filter(F.col("vec_id") % EVERY == 0).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies")).withColumn("query_key", F.xxhash64("vec_id", "vector"))
    parts = max(1, -(-count // EVERY // QUERIES_AT_ONCE))
    # A block is searched by each part of the queries in a task of its own.
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = queries.withColumn("part", F.pmod("query_key", F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _searched(d, q, width, ratio)

    found = data.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(run, "query_id long, query_key long, copies long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= TOP).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
