"""Clusters of draws by their features."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .stats import features

FEATURES = ["sum", "even_ratio", "min", "max", "std", "mean", "range", "low_fraction", "mid_fraction"]


def feature_vectors(draws: DataFrame, *keep: str) -> DataFrame:
    """The features of every complete draw as one vector, unscaled."""
    made = features(draws, *keep)
    return VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(made)


def fit(vectors: DataFrame, k: int = 5, restarts: int = 10, seed: int = 42, max_iter: int = 300) -> KMeansModel:
    """The best of `restarts` k-means fits by cost, each of at most `max_iter` iterations. Fewer than 3 k draws raise ValueError."""
    n = vectors.count()
    if n < 3 * k:
        raise ValueError(f"{n} draws are too few for {k} clusters")
    kmeans = KMeans(k=k, maxIter=max_iter, featuresCol="vector", predictionCol="cluster")
    fits = [kmeans.setSeed(seed + i).fit(vectors) for i in range(restarts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def assign(draws: DataFrame, k: int = 5, *keep: str) -> DataFrame:
    """(keep..., features..., cluster)."""
    vectors = cut(feature_vectors(draws, *keep))
    return fit(vectors, k).transform(vectors).drop("vector")


def profiles(assigned: DataFrame) -> DataFrame:
    """(cluster, size, pct, mean_sum, mean_even_ratio, mean_std), pct as text with one decimal."""
    n = assigned.agg(F.count("*").alias("n"))
    per = assigned.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("sum").alias("mean_sum"), F.avg("even_ratio").alias("mean_even_ratio"), F.avg("std").alias("mean_std")
    )
    return per.join(F.broadcast(n)).select(
        "cluster", "size", F.format_string("%.1f%%", 100.0 * F.col("size") / F.col("n")).alias("pct"), "mean_sum", "mean_even_ratio", "mean_std"
    )
