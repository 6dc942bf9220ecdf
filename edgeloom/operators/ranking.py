"""Nearest neighbours by inner product, and candidate lists for ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.operators.graph import mask_edges, neighbour_sums
from edgeloom.operators.scorers import keep_top, score_pairs
from edgeloom.storage import materialise


def knn_inner_product(keys: DataFrame, queries: DataFrame, k: int, key_bonus: str | None = None, block_rows: int = 20_000, exclude_self: bool = False) -> DataFrame:
    """(u, v, score, rank): each query's ``k`` best keys by inner product, exactly.

    Keys and queries are (id, vec); ``key_bonus`` names a keys' column that is added to the score (for
    instance a log-degree). Keys are cut into blocks by hash; every query meets every block - that is
    what an exact search is - and each (query part, block) task multiplies matrices and keeps k, so
    only k rows a query and block are shuffled on.
    """
    n = keys.count()
    blocks = max(1, -(-n // block_rows))
    bonus = F.lit(0.0) if key_bonus is None else F.col(key_bonus).cast("double")
    kb = keys.select(F.col("id").alias("v"), F.col("vec").alias("kv"), bonus.alias("bonus"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    parts = max(1, -(-queries.count() // block_rows))
    qb = queries.select(F.col("id").alias("u"), F.col("vec").alias("qv"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    qb = qb.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kb = kb.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"u": [], "v": [], "score": []}).astype({"u": "int64", "v": "int64", "score": "float64"})
        ids = b["v"].to_numpy()
        m = np.array(b["kv"].tolist(), dtype=np.float64).T
        out = []
        for i in range(0, len(q), 1024):
            x = q.iloc[i : i + 1024]
            s = np.array(x["qv"].tolist(), dtype=np.float64) @ m + b["bonus"].to_numpy()
            u = x["u"].to_numpy()
            if exclude_self:
                s[u[:, None] == ids[None, :]] = -np.inf
            take = min(k, s.shape[1])
            # By score, then id: order ids first and sort stably.
            order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 12)), axis=1)[:, :take]
            out.append(pd.DataFrame({"u": np.repeat(u, take), "v": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()}))
        return pd.concat(out)

    near = qb.groupBy("part", "block").cogroup(kb.groupBy("part", "block")).applyInPandas(best, "u long, v long, score double")
    near = near.where(F.col("score") > F.lit(float("-inf"))).withColumn("score", F.round("score", 9))
    return keep_top(near, k)


def log_degree_bonus(emb: DataFrame, deg: DataFrame) -> DataFrame:
    """(id, vec, bonus): log of the degree, of 1 for nodes without edges."""
    return emb.join(deg.select(F.col("u").alias("id"), "k"), "id", "left").select("id", "vec", F.log(F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)).cast("double")).alias("bonus"))


def degree_share_bonus(emb: DataFrame, deg: DataFrame) -> DataFrame:
    total = deg.agg(F.sum("k")).first()[0] or 1
    return emb.join(deg.select(F.col("u").alias("id"), "k"), "id", "left").select("id", "vec", (F.log(F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)) / F.lit(float(total)))).alias("bonus"))


def candidates(name: str, sym: DataFrame, deg: DataFrame, focal: DataFrame, k: int) -> DataFrame:
    """(u, v) to score for focal nodes (u): top degrees, pairs with a shared neighbour, or all nodes;
    without neighbours and the node itself."""
    if name == "preferentialAttachment":
        most = deg.agg(F.max("k")).first()[0] or 0
        best = deg.orderBy(F.desc("k"), "u").limit(k + int(most) + 1).select(F.col("u").alias("v"))
        pairs = focal.select("u").join(F.broadcast(best), F.lit(True))  # k + max degree + 1 rows
    elif name in ("commonNeighbors", "jaccardIndex", "resourceAllocation", "adamicAdar"):
        pairs = neighbour_sums(sym).select("u", "v").join(focal.select("u"), "u", "left_semi")
    else:
        two = neighbour_sums(sym).select("u", "v").join(focal.select("u"), "u", "left_semi")
        three = two.select("u", F.col("v").alias("z")).join(sym.select(F.col("u").alias("z"), "v"), "z").select("u", "v")
        pairs = two.union(three).union(sym.select("u", "v").join(focal.select("u"), "u", "left_semi")).distinct()
    return mask_edges(pairs.where("u <> v"), sym)


def rank_by_topology(name: str, sym: DataFrame, deg: DataFrame, focal: DataFrame, k: int) -> DataFrame:
    pairs = materialise(candidates(name, sym, deg, focal, k).select(F.col("u").alias("src"), F.col("v").alias("trg")), "rank-candidates")
    scored = score_pairs(name, sym, deg, pairs).select(F.col("src").alias("u"), F.col("trg").alias("v"), F.round("score", 12).alias("score"))
    return keep_top(scored, k)


def rank_by_embedding(emb: DataFrame, sym: DataFrame, deg: DataFrame, k: int, degree_corrected: bool = False, metric: str = "dot") -> DataFrame:
    """Best partners by inner product that aren't neighbours; ``cosine`` divides by norms first."""
    from edgeloom.functions.expressions import norm

    if metric == "cosine":
        emb = emb.withColumn("n", F.greatest(norm("vec"), F.lit(1e-300))).select("id", F.transform("vec", lambda x: x / F.col("n")).alias("vec"))
    keys = degree_share_bonus(emb, deg) if degree_corrected else emb.withColumn("bonus", F.lit(0.0))
    # No node has more neighbours than the largest degree: that many more keep k after masking.
    most = int(deg.agg(F.max("k")).first()[0] or 0)
    near = knn_inner_product(keys, emb, k + most, "bonus", exclude_self=True)
    return keep_top(mask_edges(near.drop("rank"), sym), k)


def global_top(scores: DataFrame, n: int) -> DataFrame:
    """The best ``n`` pairs of all, by score then ids."""
    return scores.orderBy(F.desc("score"), "src", "trg").limit(n)


def dense_rank_by(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    return rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(score))).cast("long"))
