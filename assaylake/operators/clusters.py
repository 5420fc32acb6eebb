"""Clusters of features: fine ones by k-means, small ones merged, coarse ones nested by Ward's cost, in order of a mean.

Features stay in a table of (id, z array<double>); what comes to the driver is one row of sums for each cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fine_clusters(z: DataFrame, id_col: str, k: int, starts: int = 3, seed: int = 42) -> DataFrame:
    """(id, z, label): the best of some k-means runs."""
    if k == 1:
        return z.select(id_col, "z", F.lit(0).alias("label"))
    data = z.withColumn("features", array_to_vector("z")).cache()
    models = [KMeans(k=k, seed=seed + i).fit(data) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(data).select(id_col, "z", F.col("prediction").alias("label"))
    data.unpersist()
    return out


def sums(labelled: DataFrame, more: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, sizes, centroids, sums of `more`) of each cluster: partial sums by Spark, a row a cluster here."""
    width = len(labelled.select("z").head().z)
    aggs = [F.count("*").alias("n"), *[F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(width)], F.sum(F.col(more) if more else F.lit(0.0)).alias("more")]
    rows = labelled.groupBy("label").agg(*aggs).orderBy("label").collect()
    sizes = np.array([r.n for r in rows], float)
    total = np.array([[r[f"s{i}"] for i in range(width)] for r in rows], float)
    return np.array([r.label for r in rows]), sizes, total / sizes[:, None], np.array([r.more for r in rows], float)


def merge_small(sizes: np.ndarray, centroids: np.ndarray, least: int, keep: int = 1) -> np.ndarray:
    """For each cluster the one it ends in, counted from 0 in their order: the smallest cluster under `least` joins the
    nearest centroid, ties by order, until none is that small or only `keep` are left. A joined centroid is the mean by
    size, so no feature is read again."""
    into = np.arange(len(sizes))
    sizes, centroids = sizes.astype(float).copy(), centroids.astype(float).copy()
    alive = list(range(len(sizes)))
    while len(alive) > keep:
        victim = min(alive, key=lambda c: (sizes[c], c))
        if sizes[victim] >= least:
            break
        alive.remove(victim)
        target = min(alive, key=lambda c: (float(np.sum((centroids[c] - centroids[victim]) ** 2)), c))
        both = sizes[target] + sizes[victim]
        centroids[target] = (centroids[target] * sizes[target] + centroids[victim] * sizes[victim]) / both
        sizes[target] = both
        into[into == victim] = target
    return np.unique(into, return_inverse=True)[1]


def ward(points: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (a, b, cost) of points in rising order of Ward's cost, by a chain of nearest neighbours: each step looks at
    the distances of one cluster, and two that are each other's nearest may merge at once, whatever else is left.

    A merge names its two clusters by their smallest members. Weights are those of points, 1 unless given.
    """
    n = len(points)
    weight = np.ones(n) if weights is None else weights.astype(float).copy()
    centre = points.astype(float).copy()
    alive, chain, merges = set(range(n)), [], []

    def cost(a: int, b: int) -> float:
        return weight[a] * weight[b] / (weight[a] + weight[b]) * float(np.sum((centre[a] - centre[b]) ** 2))

    while len(alive) > 1:
        if not chain:
            chain.append(min(alive))
        top = chain[-1]
        others = sorted(alive - {top})
        costs = [cost(top, o) for o in others]
        least = min(costs)
        before = chain[-2] if len(chain) > 1 else None
        near = before if before is not None and cost(top, before) <= least else others[costs.index(least)]
        if near != before:
            chain.append(near)
            continue
        a, b = sorted((top, near))
        merges.append((a, b, least))
        both = weight[a] + weight[b]
        centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / both
        weight[a] = both
        alive.remove(b)
        del chain[-2:]
    # costs never fall from a merge to one that builds on it, so in rising order each level is a cut
    return sorted(merges, key=lambda m: m[2])


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels of n points once k clusters are left; a coarser cut only joins what a finer one has."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in merges[: max(0, n - k)]:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def by_mean(labels: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Labels of fine clusters renamed so that cluster 0 has the smallest mean; ties by label."""
    k = labels.max() + 1
    means = [total[labels == c].sum() / n[labels == c].sum() for c in range(k)]
    place = np.empty(k, int)
    place[sorted(range(k), key=lambda c: (means[c], c))] = np.arange(k)
    return place[labels]


def nested(labelled: DataFrame, id_col: str, mean_of: str, levels: tuple[int, ...], least: int) -> DataFrame:
    """(id, k<level>...) from (id, z, label, mean_of): small clusters merged, then joined level by level, all in order of
    the mean of a column. Where fewer clusters are left than a level asks for, it has those."""
    names, sizes, centroids, total = sums(labelled, mean_of)
    merged = merge_small(sizes, centroids, least)
    k = int(merged.max()) + 1
    n = np.bincount(merged, sizes)
    mean = np.bincount(merged, total)
    centre = np.stack([np.bincount(merged, sizes * centroids[:, i]) for i in range(centroids.shape[1])], axis=1) / n[:, None]
    merges = ward(centre)
    spark = labelled.sparkSession
    found = [by_mean(cut(merges, k, min(level, k)), n, mean)[merged].tolist() for level in levels]
    rows = [(int(x), *per) for x, *per in zip(names, *found, strict=True)]
    table = spark.createDataFrame(rows, "label int, " + ", ".join(f"k{level} int" for level in levels))  # one row for each fine cluster
    return labelled.join(F.broadcast(table), "label").select(id_col, *[f"k{level}" for level in levels])
