"""Clustering of papers by their vectors."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seeds, largest number of clusters tried, and the share of an even cluster that the smallest must have.
SEEDS, MOST, SHARE = range(42, 52), 8, 4


def kmeans(df: DataFrame, vector: str, k: int, seeds=SEEDS) -> tuple[DataFrame, float]:
    """(df with cluster, silhouette): the first seed whose smallest cluster has max(2, n / 4k) rows, else the best silhouette (L1)."""
    data = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    n, best = data.count(), None
    for seed in seeds:
        out = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(data).transform(data)
        sizes = [r["count"] for r in out.groupBy("cluster").count().collect()]  # k rows
        score = ClusteringEvaluator(featuresCol="__v", predictionCol="cluster").evaluate(out) if len(sizes) > 1 else -1.0
        if best is None or score > best[1]:
            best = out, score
        if len(sizes) == k and min(sizes) >= max(2, math.ceil(n / (SHARE * k))):
            best = out, score
            break
    return best[0].drop("__v"), best[1]


def cluster(df: DataFrame, vector: str, k: int | None = None, seeds=SEEDS) -> tuple[DataFrame, float]:
    """Clusters by a number of them, or by that from 2 to MOST with the best silhouette (L1). Fewer than three rows are one each."""
    n = df.count()
    if n < 3:
        return df.withColumn("cluster", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).cast("int")), 0.0
    if k is not None:
        return kmeans(df, vector, max(2, min(k, n - 1)), seeds)
    return max((kmeans(df, vector, c, seeds) for c in range(2, min(MOST, n - 1) + 1)), key=lambda x: x[1])


def with_fallback(df: DataFrame, method: str, topic: str, least: float = 0.15, **more) -> tuple[DataFrame, float, str]:
    """Clusters by method vectors, or by topic vectors if those give a silhouette below `least` (L2)."""
    out, score = cluster(df, method, **more)
    if score >= least:
        return out, score, "method"
    out, score = cluster(df, topic, **more)
    return out, score, "topic"
