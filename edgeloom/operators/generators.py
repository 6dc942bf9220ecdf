"""Synthetic networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import schema
from edgeloom.operators.graph import canonical_edges


def partition_model(spark: SparkSession, n: int, q: int, mean_degree: float, mixing: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, membership) of q equal blocks; each pair's expected number of links depends on its blocks.

    Links are drawn, not pairs tested: a block pair gets its expected number of draws of both ends, so
    the cost follows the edges. Repeated draws are one edge.
    """
    out = max(1.0, mixing * mean_degree)
    inside = q * mean_degree - (q - 1) * out
    size = n // q
    member = spark.range(n).select(F.col("id").alias("node_id"), F.least((F.col("id") / size).cast("int"), F.lit(q - 1)).alias("membership"))
    pairs = spark.range(q).select(F.col("id").alias("a")).join(spark.range(q).select(F.col("id").alias("b")), F.col("a") <= F.col("b"))
    expected = F.when(F.col("a") == F.col("b"), F.lit(inside * size / n * size / 2)).otherwise(F.lit(out * size / n * size))
    draws = pairs.select("a", "b", F.explode(F.sequence(F.lit(1), F.greatest(F.round(expected), F.lit(1)).cast("int"))).alias("d"))
    end = lambda g, tag: F.col(g) * size + F.pmod(F.xxhash64("a", "b", "d", F.lit(tag), F.lit(seed)), F.lit(size))
    return canonical_edges(draws.select(end("a", 1).alias("u"), end("b", 2).alias("v")).where("u <> v")), member


def price_model(spark: SparkSession, m: int, k0: float, n: int, seed: int = 0) -> DataFrame:
    """Citations of the Price model: each new node cites m earlier ones, in proportion to citations plus k0.

    Sequential by definition, so it runs on the driver.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    cited: list[int] = []
    rows = [(i, j) for i in range(m + 1) for j in range(i)]
    cited += [j for _, j in rows]
    for i in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            by_citation = draw.random() < len(cited) / (len(cited) + k0 * i)
            chosen.add(cited[draw.integers(len(cited))] if by_citation else int(draw.integers(i)))
        rows += [(i, j) for j in sorted(chosen)]
        cited += sorted(chosen)
    return canonical_edges(spark.createDataFrame(rows, schema.EDGES))


def lfr_model(spark: SparkSession, n: int, mean_degree: float, mixing: float, tau: float = 2.5, seed: int = 0, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, membership) with power-law degrees and a share ``mixing`` of each node's links leaving its
    block: stubs are matched by hash order within blocks and over the whole network."""
    q = blocks or max(2, int(round(n**0.5 / 4)))
    low = mean_degree * (tau - 2) / (tau - 1)
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) + 1) / F.lit(1_000_004.0)
    k = F.least(F.greatest(F.round(F.lit(low) * F.pow(u, F.lit(-1.0 / (tau - 1)))), F.lit(1)), F.lit(int((10 * n) ** 0.5))).cast("int")
    nodes = spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(q)).alias("g"), k.alias("k"))
    ends = nodes.select("id", "g", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("s"))
    leaves = F.pmod(F.xxhash64("id", "s", F.lit(seed + 2)), F.lit(1_000_003)) < int(mixing * 1_000_003)
    ends = ends.select("id", F.when(leaves, F.lit(-1)).otherwise(F.col("g")).alias("pool"), F.xxhash64("id", "s", F.lit(seed + 3)).alias("h"))
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("pool").orderBy("h", "id")) - 1
    matched = ends.select("id", "pool", F.floor(i / 2).alias("pair")).groupBy("pool", "pair").agg(F.min("id").alias("u"), F.max("id").alias("v"), F.count(F.lit(1)).alias("n"))
    member = nodes.select(F.col("id").alias("node_id"), F.col("g").cast("int").alias("membership"))
    return canonical_edges(matched.where("n = 2 and u <> v").select("u", "v")), member
