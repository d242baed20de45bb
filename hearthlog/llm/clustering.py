"""Centroid clustering in whole numbers: Lloyd's rounds whose result doesn't depend on how Spark deals the rows.

1. Vectors with DIM usable components become blocks of whole numbers, floor(SCALE * x), in a table.
2. The first centroids are the K vectors whose sha256 of "SEED:id" is least.
3. A round assigns each block's vectors by |x|^2 - 2 x.c + |c|^2, one float64 matrix product a block. All terms and
   sums are whole numbers; while DIM * (max|x| + max|c|)^2 is below 2^53 none is rounded, in whatever order BLAS adds.
   Blocks beyond that bound are computed with Python's integers. Sums and counts of K clusters, whose size doesn't
   depend on the input, combine in a tree (RDD.treeAggregate); a centroid becomes floor(sum / count).
4. After ROUNDS rounds vectors are assigned once more. A round that changes no centroid is the last.

Defined cases: null vectors, vectors of another length and those with a null or non-finite component take no part;
fewer vectors than K are as many centroids; a null id takes part, but is no first centroid; of vectors with one id
the first centroids take the one whose components come first; repeated rows count each; an empty table gives an empty
result; a distance or sum beyond the range of a long becomes the largest long (it is compared and summed exactly);
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import EXACT, LONG, blocks, matrix, quantised, to_long, usable, whole

K, ROUNDS, SCALE, DIM, SEED = 8, 10, 1024, 64, 3


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact: float64, or Python's integers beyond the bound."""
    most = max((abs(v) for c in centroids for v in c), default=0)
    if x.shape[1] * (int(np.abs(x).max(initial=0)) + most) ** 2 < EXACT:
        c = np.array(centroids, float)
        return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)
    a, c = whole(x), np.array(centroids, object)
    return np.array((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1), object)


def assign(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number."""
    d = distances(x, centroids)
    cluster = d.argmin(1)
    return cluster, d[np.arange(len(d)), cluster]


def totals(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of each cluster, exact, as Python's integers."""
    if np.abs(x).max(initial=0) * len(x) < EXACT:
        one = np.zeros((k, len(x)))
        one[cluster, np.arange(len(x))] = 1
        return whole(one @ x)
    return np.array([whole(x[cluster == j]).sum(0) if (cluster == j).any() else [0] * x.shape[1] for j in range(k)], object)


def first_centroids(df: DataFrame, id_: str, vector: str, k: int = K, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the least hash, in its order; k rows reach the driver."""
    x = df.filter(F.col(id_).isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256).alias("h"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    return [[int(v) for v in quantised(np.array(r["v"]), scale)] for r in x.orderBy("h", "v").limit(k).collect()]


def step(table: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list, list[int]]:
    """One pass over the blocks: members, sums and summed distances by cluster."""
    k, width = len(centroids), len(centroids[0])
    shared = table.sparkSession.sparkContext.broadcast(centroids)  # k vectors

    def add(acc, block):
        n, total, cost = acc
        x = matrix(block)
        cluster, d = assign(x, shared.value)
        inertia = np.zeros(k, object)
        np.add.at(inertia, cluster, whole(d))
        return n + np.bincount(cluster, minlength=k).astype(object), total + totals(x, cluster, k), cost + inertia

    zero = (np.zeros(k, object), np.zeros((k, width), object), np.zeros(k, object))
    n, total, cost = table.select("n", "width", "kind", "data").rdd.treeAggregate(zero, add, lambda a, b: tuple(x + y for x, y in zip(a, b)))
    shared.unpersist()
    return [int(v) for v in n], total, [int(v) for v in cost]


def fit(table: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after `rounds` rounds; an empty cluster keeps its own."""
    for _ in range(rounds):
        n, total, _ = step(table, centroids)
        moved = [[int(v) // n[j] for v in total[j]] if n[j] else centroids[j] for j in range(len(centroids))]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def centroid_clusters(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    spark = df.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = df.filter(usable(df, vector, dim))
    table = settle(blocks(kept, id_, vector, scale, dim), "vectors")
    start = first_centroids(kept, id_, vector, k, scale, seed)
    if not start:
        return spark.createDataFrame([], schema)
    centroids = fit(table, start, rounds)
    _, _, cost = step(table, centroids)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [min(c, LONG) for c in cost]
    total = min(sum(cost), LONG)

    def last(batches):
        for b in batches:
            for block in b.to_pylist():
                cluster, d = assign(matrix(block), centroids)
                ids = pa.array(np.frombuffer(block["ids"], "<i8"), mask=np.frombuffer(block["known"], "u1") == 0)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids, "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(to_long(d)), "cluster_inertia": pa.array([inertia[j] for j in cluster], pa.int64()),
                    "inertia": pa.array([total] * len(d), pa.int64()), "centroid_sha256": pa.array([digest[j] for j in cluster], pa.string()),
                })

    return table.mapInArrow(last, schema)
