"""KMeans over delay percentiles."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.operators.delays import FEATURE_COLS

# The K values swept and the K chosen.
K_SWEEP = [10, 50, 100, 200, 300, 500, 800]
K_CHOSEN = 200


def features(pcts: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """Percentile columns → one feature vector."""
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(pcts)


def fit_kmeans(feats: DataFrame, k: int, seed: int = 0, max_iter: int = 50):
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features",
                  predictionCol="cluster").fit(feats)


def cluster_labels(feats: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Adds ``cluster`` to every row (M1, M3, J8: the row keeps its id, no join).
    With fewer than two clusters requested every row is cluster 0."""
    if k < 2:
        return feats.drop("features").withColumn("cluster", F.lit(0))
    model = fit_kmeans(feats, k, seed)
    return model.transform(feats).drop("features")


def kmeans_sweep(feats: DataFrame, ks=K_SWEEP, seed: int = 0) -> DataFrame:
    """(k, inertia) for each K (M2). Each fit is a distributed job; the input
    is cached once. A K above the number of distinct rows is fitted too: there
    each distinct row is a centre."""
    spark = feats.sparkSession
    feats = feats.select("features").cache()
    rows = []
    for k in ks:
        model = fit_kmeans(feats, k, seed)
        rows.append((int(k), float(model.summary.trainingCost)))
    feats.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double")


def cluster_sample(labels: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """``n`` clusters chosen at random (seeded hash order), renumbered 0…n−1."""
    chosen = (labels.select("cluster").distinct()
              .withColumn("_h", F.xxhash64("cluster", F.lit(seed)))
              .orderBy("_h", "cluster").limit(n))
    from pyspark.sql import Window
    return chosen.withColumn("plot_id", F.row_number().over(Window.orderBy("_h", "cluster")) - 1).drop("_h")
