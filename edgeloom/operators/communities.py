"""Clusters of nodes: k-means, hierarchical k-means, label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.expressions import norm
from edgeloom.storage import materialise


def kmeans(emb: DataFrame, k: int, metric: str = "euclidean", seed: int = 0, bisecting: bool = False) -> DataFrame:
    """(id, group): rows with a missing or NaN element get a null group; ``cosine`` divides by norms first."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    good = emb.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double"))))
    data = good.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    if metric == "cosine":
        data = data.withColumn("n", F.greatest(norm("vec"), F.lit(1e-300))).select("id", F.transform("vec", lambda x: x / F.col("n")).alias("vec"))
    data = materialise(data.select("id", array_to_vector("vec").alias("features")), "kmeans")
    kind = BisectingKMeans if bisecting else KMeans
    groups = kind(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("group"))
    return emb.select("id").join(groups, "id", "left")


def label_propagation(sym: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, g): each node takes its neighbours' most frequent label, the smallest of equals; synchronous."""
    sym = materialise(sym, "lpa-graph")
    state = materialise(sym.select(F.col("u").alias("node")).distinct().withColumn("g", F.col("node")), "lpa")
    for _ in range(rounds):
        votes = sym.join(state.select(F.col("node").alias("v"), "g"), "v").groupBy("u", "g").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("u").agg(F.max(F.struct("n", (-F.col("g")).alias("m"))).alias("t"))
        state = materialise(best.select(F.col("u").alias("node"), (-F.col("t.m")).alias("g")), "lpa")
    return state
