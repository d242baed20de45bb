"""Clustering of vectors (Spark ML) and samples of clusters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stage
from .aggregates import counts_with_zeros, share


def _vectors(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.transform(c, lambda x: x.cast("double"))))


#: Fits that run beside each other: a fit is a chain of small jobs, which leave executors idle between them.
BESIDE = 4


def _fits(x: DataFrame, settings: list[tuple[int, int, int]]) -> list:
    """Models of (k, seed, rounds), in order; the input should be at hand."""
    fit = inheritable_thread_target(x.sparkSession)(lambda s: KMeans(featuresCol="__v", predictionCol="__c", k=s[0], seed=s[1], maxIter=s[2]).fit(x.select("__v")))
    with ThreadPoolExecutor(BESIDE) as pool:
        return list(pool.map(fit, settings))


def kmeans(df: DataFrame, vector: str, k: int = 7, seed: int = 42, n_init: int = 10, max_iter: int = 50) -> tuple[DataFrame, list]:
    """M1: labels of the best of n_init starts, and its centres. The input is cached while the starts read it."""
    x = _vectors(df, vector).persist()
    best = min(_fits(x, [(k, seed + i, max_iter) for i in range(n_init)]), key=lambda m: m.summary.trainingCost)
    x.unpersist()
    return best.transform(_vectors(df, vector)).withColumn("cluster", F.col("__c")).drop("__v", "__c"), [c.tolist() for c in best.clusterCenters()]


def choose_k(df: DataFrame, vector: str, ks=range(2, 20), seed: int = 42, sample: int = 10000, id_: str = "id") -> DataFrame:
    """M2: inertia and silhouette (Euclidean, on a sample) of each k; the best k is the first with the largest."""
    x, ks = _vectors(df, vector).persist(), list(ks)
    models = _fits(x, [(k, seed, 50) for k in ks])
    x.unpersist()
    centres = {k: [c.tolist() for c in m.clusterCenters()] for k, m in zip(ks, models)}
    costs = df.sparkSession.createDataFrame([(k, float(m.summary.trainingCost)) for k, m in zip(ks, models)], "k int, inertia double")
    found = silhouettes(sample_rows(df, id_, sample, seed), vector, centres, id_)
    return costs.join(F.broadcast(found), "k", "left").select("k", "inertia", "silhouette")


def silhouettes(rows: DataFrame, vector: str, centres: dict[int, list], id_: str, block: int = 512) -> DataFrame:
    """(k, silhouette): mean silhouette, by Euclidean distance, of rows assigned to the nearest of each k centres; null
    where all rows are in one cluster.

    Rows are dealt into blocks of about `block`; each pair of blocks meets on an executor, and a row keeps only its sums
    by cluster. Distances are computed once for all k. rows is a sample of bounded size.
    """
    n = rows.count()
    blocks = max(1, -(-n // block))
    v = F.transform(vector, lambda x: x.cast("double"))
    held = stage(rows.select(F.pmod(F.xxhash64(F.col(id_)), F.lit(blocks)).cast("int").alias("b"), v.alias("v")).groupBy("b").agg(F.collect_list("v").alias("v")), "blocks")
    one = held.select(F.col("b").alias("a"), F.col("v").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    pairs = one.join(held, "b").repartition(blocks, "a")  # each block with all others, as partial sums of one task
    c = {k: np.array(m) for k, m in centres.items()}

    def labels(x):
        return {k: ((m * m).sum(1) - 2 * np.einsum("ik,jk->ij", x, m)).argmin(1) for k, m in c.items()}

    def meet(key, frame):
        own = np.array(frame["own"].iloc[0].tolist())
        sums = {k: np.zeros((len(own), len(m))) for k, m in c.items()}
        size = {k: np.zeros(len(m)) for k, m in c.items()}
        for other in frame["v"]:
            x = np.array(other.tolist())
            d = np.sqrt(np.maximum(0, (own**2).sum(1)[:, None] + (x**2).sum(1) - 2 * np.einsum("ik,jk->ij", own, x)))
            for k, lab in labels(x).items():
                one = np.zeros((len(x), len(c[k])))
                one[np.arange(len(x)), lab] = 1
                sums[k] += np.einsum("ij,jk->ik", d, one)
                size[k] += one.sum(0)
        out = []
        for k, lab in labels(own).items():
            i = np.arange(len(own))
            mine = size[k][lab]
            a = sums[k][i, lab] / np.maximum(1, mine - 1)
            rest = np.where(size[k] > 0, sums[k] / np.maximum(1, size[k]), np.inf)
            rest[i, lab] = np.inf
            b = rest.min(1)
            s = np.where((mine > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, np.where(np.isfinite(b), b, 0)), 1e-300), 0)
            out.append((k, float(s.sum()), len(own), bool((size[k] > 0).sum() > 1)))
        return pd.DataFrame(out, columns=["k", "s", "n", "several"])

    sums = pairs.groupBy("a").applyInPandas(meet, "k int, s double, n long, several boolean")
    return sums.groupBy("k").agg(F.when(F.bool_or("several"), F.sum("s") / F.sum("n")).alias("silhouette"))


def sub_clusters(df: DataFrame, vector: str, label: str, of: int, k: int, seed: int = 42) -> DataFrame:
    """M3: clusters within one cluster; -1 for rows outside, all 0 where it has fewer than k members."""
    inside = df.filter(F.col(label) == of)
    if inside.limit(k).count() < k:
        return df.withColumn("sub_cluster", F.when(F.col(label) == of, 0).otherwise(-1))
    own = "cluster" in df.columns
    x, _ = kmeans(inside.withColumnRenamed("cluster", "__own"), vector, k, seed)
    rest = df.filter(F.coalesce(F.col(label) != of, F.lit(True))).withColumn("sub_cluster", F.lit(-1))
    x = x.withColumn("sub_cluster", F.col("cluster")).drop("cluster")
    return (x.withColumnRenamed("__own", "cluster") if own else x).unionByName(rest)


def cluster_stats(df: DataFrame, label: str, k: int) -> DataFrame:
    """Count and share of each cluster, empty ones too."""
    return share(counts_with_zeros(df, label, df.sparkSession.range(k).select(F.col("id").cast("int").alias(label))))


def sub_cluster_stats(df: DataFrame, label: str, emotions: list[str]) -> DataFrame:
    """Members only; means of emotions to three digits."""
    m = df.filter(F.col(label) >= 0)
    return share(m.groupBy(label).agg(F.count("*").alias("n"), *[F.bround(F.avg(e), 3).alias(e) for e in emotions]))


def draw(id_, seed: int = 42) -> Column:
    """A fixed random order."""
    return F.md5(F.concat_ws(":", (F.col(id_) if isinstance(id_, str) else id_).cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """T12."""
    return df.orderBy(draw(id_, seed), id_).limit(n)


def sample_per(df: DataFrame, label: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    """T11."""
    w = Window.partitionBy(label).orderBy(draw(id_, seed), id_)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def weights_valid(df: DataFrame, w: str) -> DataFrame:
    """Whether weights sum to one, and the weights that do."""
    total = df.agg(F.sum(w).alias("__t"))  # one row
    return df.join(F.broadcast(total)).select("*", (F.abs(F.col("__t") - 1) <= 0.01).alias("valid"), F.bround(F.col(w) / F.col("__t"), 3).alias("normalised")).drop("__t")
