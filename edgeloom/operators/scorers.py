"""Topology scores of node pairs.

``@scorer`` registers a function of (sym, deg, pairs) that returns pairs with a score; ``top_k`` scores
the pairs that share a neighbour (or are three steps apart) instead, masks training edges and keeps
each node's best. ``score_models`` and the path scores' ``top_k`` work in tasks that hold the graph
(``around``). The registered scorers, and both of these on a graph too large to be held, are equi-joins: pairs
with the neighbours of one end, then with the edges of the other; a length-three path is counted from
both ends, so nothing cubes the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from edgeloom.operators import around
from edgeloom.operators.graph import degrees, mask_edges, neighbour_sums
from edgeloom.storage import materialise, shuffle_width

Scorer = Callable[..., DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    def put(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return put


def with_degrees(deg: DataFrame, pairs: DataFrame) -> DataFrame:
    one = pairs.join(deg.select(F.col("u").alias("src"), F.col("k").alias("ki")), "src", "left")
    two = one.join(deg.select(F.col("u").alias("trg"), F.col("k").alias("kj")), "trg", "left")
    return two.withColumns({"ki": F.coalesce("ki", F.lit(0)), "kj": F.coalesce("kj", F.lit(0))})


def shared_neighbours(sym: DataFrame, pairs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """pairs with s: the number, or sum of weights (u, w), of common neighbours."""
    keys = pairs.select("src", "trg").distinct()
    near = keys.join(sym.select(F.col("u").alias("src"), F.col("v").alias("z")), "src")
    both = near.join(sym.select(F.col("u").alias("trg"), F.col("v").alias("z")), ["trg", "z"])
    if weights is not None:
        both = both.join(weights.select(F.col("u").alias("z"), "w"), "z")
    sums = both.groupBy("src", "trg").agg((F.count(F.lit(1)) if weights is None else F.sum("w")).cast("double").alias("s"))
    return pairs.join(sums, ["src", "trg"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def three_steps(sym: DataFrame, pairs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """pairs with s: the number of walks src-z-w-trg, or the sum of the products of z's and w's weights."""
    keys = pairs.select("src", "trg").distinct()
    near = keys.join(sym.select(F.col("u").alias("src"), F.col("v").alias("z")), "src")
    far = near.join(sym.select(F.col("u").alias("trg"), F.col("v").alias("w")), "trg")
    shut = far.join(sym.select(F.col("u").alias("z"), F.col("v").alias("w")), ["z", "w"])
    if weights is None:
        sums = shut.groupBy("src", "trg").agg(F.count(F.lit(1)).cast("double").alias("s"))
    else:
        shut = shut.join(weights.select(F.col("u").alias("z"), F.col("w").alias("wz")), "z").join(weights.select(F.col("u").alias("w"), F.col("w").alias("ww")), "w")
        sums = shut.groupBy("src", "trg").agg(F.sum(F.col("wz") * F.col("ww")).alias("s"))
    return pairs.join(sums, ["src", "trg"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def inverse_degree(deg: DataFrame) -> DataFrame:
    return deg.select("u", (F.lit(1.0) / F.col("k")).alias("w"))


def clamped_log_weight(deg: DataFrame) -> DataFrame:
    return deg.select("u", (F.lit(1.0) / F.greatest(F.log(F.greatest("k", F.lit(1)).cast("double")), F.lit(1.0))).alias("w"))


def _done(df: DataFrame, score: Column, pairs: DataFrame) -> DataFrame:
    return df.select(*pairs.columns, score.cast("double").alias("score"))


@scorer("preferentialAttachment")
def preferential_attachment(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    return _done(with_degrees(deg, pairs), F.col("ki") * F.col("kj"), pairs)


@scorer("logPreferentialAttachment")
def log_preferential_attachment(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    log = lambda c: F.log(F.greatest(c, F.lit(1)).cast("double"))
    return _done(with_degrees(deg, pairs), log("ki") + log("kj"), pairs)


@scorer("commonNeighbors")
def common_neighbours(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    return _done(shared_neighbours(sym, pairs), F.col("s"), pairs)


@scorer("jaccardIndex")
def jaccard(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    df = with_degrees(deg, shared_neighbours(sym, pairs))
    return _done(df, F.col("s") / F.greatest(F.col("ki") + F.col("kj") - F.col("s"), F.lit(1.0)), pairs)


@scorer("resourceAllocation")
def resource_allocation(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    return _done(shared_neighbours(sym, pairs, inverse_degree(deg)), F.col("s"), pairs)


@scorer("adamicAdar")
def adamic_adar(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    """Logarithms of degrees are at least 1."""
    return _done(shared_neighbours(sym, pairs, clamped_log_weight(deg)), F.col("s"), pairs)


@scorer("adamicAdarTextbook")
def adamic_adar_textbook(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    w = deg.where("k > 1").select("u", (F.lit(1.0) / F.log(F.col("k").cast("double"))).alias("w"))
    return _done(shared_neighbours(sym, pairs, w), F.col("s"), pairs)


@scorer("leichtHolmeNewman")
def leicht_holme_newman(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    df = with_degrees(deg, shared_neighbours(sym, pairs))
    return _done(df, F.when(F.col("ki") * F.col("kj") > 0, F.col("s") / (F.col("ki") * F.col("kj"))).otherwise(0.0), pairs)


@scorer("localRandomWalk")
def local_random_walk(sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k_i / sum k) times the probability mass of one, two and three steps from i to j."""
    w = inverse_degree(deg)
    total = deg.agg(F.sum("k")).first()[0] or 1
    direct = sym.select(F.col("u").alias("src"), F.col("v").alias("trg"), F.lit(1.0).alias("e"))
    df = three_steps(sym, shared_neighbours(sym, pairs, w).withColumnRenamed("s", "s2"), w).join(direct, ["src", "trg"], "left")
    return _done(df, (F.coalesce("e", F.lit(0.0)) + F.col("s2") + F.col("s")) / F.lit(float(total)), pairs)


@scorer("localPathIndex")
def local_path_index(sym: DataFrame, deg: DataFrame, pairs: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    df = three_steps(sym, shared_neighbours(sym, pairs).withColumnRenamed("s", "s2"))
    return _done(df, F.col("s2") + F.lit(epsilon) * F.col("s"), pairs)


def score_pairs(name: str, sym: DataFrame, deg: DataFrame, pairs: DataFrame) -> DataFrame:
    return SCORERS[name](sym, deg, pairs)


def _scores(g: around.Graph, names: Sequence[str], i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """The scores of pairs of numbers (-1: not in the graph), all from one look at the common neighbours."""
    k = g.k.astype(float)
    ki, kj = (np.where(x >= 0, k[x], 0.0) if len(k) else np.zeros(len(x)) for x in (i, j))
    log = np.log(np.maximum(k, 1))
    weights = {"one": np.ones(len(k)), "inverse": around.inverse(k), "clamped": 1 / np.maximum(log, 1), "log": np.divide(1, log, out=np.zeros(len(k)), where=k > 1)}
    uses = {"commonNeighbors": "one", "jaccardIndex": "one", "leichtHolmeNewman": "one", "localPathIndex": "one", "resourceAllocation": "inverse", "localRandomWalk": "inverse", "adamicAdar": "clamped", "adamicAdarTextbook": "log"}
    two_of = sorted({uses[x] for x in names if x in uses})
    two = dict(zip(two_of, around.common(g, i, j, [weights[x] for x in two_of]))) if two_of else {}
    three_of = sorted({uses[x] for x in names if x in ("localRandomWalk", "localPathIndex")})
    three = dict(zip(three_of, around.three(g, i, j, [weights[x] for x in three_of]))) if three_of else {}
    out = {}
    for x in names:
        s = two.get(uses.get(x))
        if x == "preferentialAttachment":
            out[x] = ki * kj
        elif x == "logPreferentialAttachment":
            out[x] = np.log(np.maximum(ki, 1)) + np.log(np.maximum(kj, 1))
        elif x == "jaccardIndex":
            out[x] = s / np.maximum(ki + kj - s, 1)
        elif x == "leichtHolmeNewman":
            out[x] = np.divide(s, ki * kj, out=np.zeros(len(s)), where=ki * kj > 0)
        elif x == "localRandomWalk":
            direct = np.zeros(len(i))
            ok = (i >= 0) & (j >= 0)
            direct[ok] = g.linked(i[ok], j[ok])
            out[x] = (direct + s + three["inverse"]) / max(float(k.sum()), 1.0)
        elif x == "localPathIndex":
            out[x] = s + 1e-3 * three["one"]
        else:
            out[x] = s
    return out


def score_models(names: Sequence[str], sym: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with a column of scores for each of ``names``, on the degrees of ``sym`` itself.

    The tasks hold the graph and pairs are scored where they are; a graph too large for that is joined,
    a model at a time.
    """
    shared = around.held(sym)
    if shared is None:
        deg, out = materialise(degrees(sym), "score-degrees"), pairs
        for x in names:
            keys = materialise(score_pairs(x, sym, deg, pairs.select("src", "trg").distinct()).withColumnRenamed("score", x), "scored")
            out = out.join(keys, ["src", "trg"])
        return out.select(*pairs.columns, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            got = _scores(g, names, *(g.number(b.column(c).to_numpy()) for c in ("src", "trg")))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(got[x], pa.float64()) for x in names]], [*b.schema.names, *names])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, *[StructField(x, DoubleType()) for x in names]]))


def _top_paths(name: str, shared, spark, k: int, exclude_self: bool) -> DataFrame:
    """``top_k`` of the path scores: each task walks three steps from its nodes and keeps their best."""
    n = len(shared.value.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        w = around.inverse(g.k) if name == "localRandomWalk" else np.ones(n)
        far = g.around(g.around(g.k[:, None]))[:, 0]
        for b in batches:
            every = b.column("id").to_numpy()
            for s in around.cut(far[every]):
                nodes = every[s]
                e, z = g.spread(nodes)
                e2, v = g.spread(z)
                key, p = around.summed(e[e2] * n + v, w[z[e2]])
                e, z = key // n, key % n
                e2, v = g.spread(z)
                step = p * w[z] if name == "localRandomWalk" else p * 1e-3
                key, p = around.summed(np.concatenate([key, e[e2] * n + v]), np.concatenate([p, step[e2]]))
                # Edges go, and the nodes themselves if asked for: both are few among the candidates.
                e, v = g.spread(nodes)
                out = e * n + v
                if exclude_self:
                    out = np.concatenate([out, np.arange(len(nodes)) * n + nodes])
                at = np.searchsorted(key, out)
                keep = np.ones(len(key), dtype=bool)
                keep[at[(at < len(key)) & (key[np.minimum(at, len(key) - 1)] == out)] if len(key) else at[:0]] = False
                # Sums of doubles differ in their last bits by order; ranks must not. Halves go up.
                key, p = key[keep], np.floor(p[keep] * 1e9 + 0.5) / 1e9
                order = np.lexsort((key, -p, key // n))
                row = (key // n)[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                top = order[rank <= k]
                yield pa.RecordBatch.from_arrays([pa.array(g.ids[x].astype(np.int64)) for x in (nodes[key[top] // n], key[top] % n)] + [pa.array(p[top]), pa.array(rank[rank <= k].astype(np.int64))], ["u", "v", "score", "rank"])

    return spark.range(0, n, 1, max(shuffle_width(spark), -(-n // 10_000))).mapInArrow(run, "u long, v long, score double, rank long")


def keep_top(scores: DataFrame, k: int, group: str = "u", score: str = "score", tie: str = "v") -> DataFrame:
    """Each group's ``k`` best by score, then smaller id, with rank from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_k(name: str, sym: DataFrame, deg: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(u, v, score, rank): each node's best partners that aren't its neighbours.

    Candidates are the pairs with a path of length two (or three, for the path scores). A node is its
    own candidate unless ``exclude_self``. Preferential attachment gives every node the same list of
    the highest degrees, unmasked.
    """
    if name == "preferentialAttachment":
        best = deg.orderBy(F.desc("k"), "u").limit(k).select(F.col("u").alias("v"), F.col("k").alias("score"))
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "v")).cast("long"))
        return deg.select("u").join(F.broadcast(ranked), F.lit(True)).select("u", "v", F.col("score").cast("double"), "rank")  # k rows are broadcast
    shared = around.held(sym) if name in ("localRandomWalk", "localPathIndex") else None
    if shared is not None:
        out = _top_paths(name, shared, sym.sparkSession, k, exclude_self)
        total = float(max(int(shared.value.k.sum()), 1))
        return out.withColumn("score", F.col("score") / F.lit(total)) if name == "localRandomWalk" else out
    weights = {"resourceAllocation": inverse_degree, "adamicAdar": clamped_log_weight, "localRandomWalk": inverse_degree}.get(name)
    two = neighbour_sums(sym, weights(deg) if weights else None)
    if name in ("localRandomWalk", "localPathIndex"):
        # Add the third step to aggregated wedges: one more join, then one sum.
        step = sym.select(F.col("u").alias("z"), F.col("v").alias("b"))
        if name == "localRandomWalk":
            total = deg.agg(F.sum("k")).first()[0] or 1
            spread = two.join(inverse_degree(deg).select(F.col("u").alias("v"), F.col("w")), "v").select("u", F.col("v").alias("z"), (F.col("paths") * F.col("w")).alias("p"))
            one = sym.select("u", "v", F.lit(1.0).alias("p"))
            three = spread.join(step, "z").select("u", F.col("b").alias("v"), "p")
            scores = one.unionByName(two.select("u", "v", F.col("paths").alias("p"))).unionByName(three).groupBy("u", "v").agg(F.sum("p").alias("score"))
        else:
            three = two.select("u", F.col("v").alias("z"), (F.col("paths") * F.lit(1e-3)).alias("p")).join(step, "z").select("u", F.col("b").alias("v"), "p")
            scores = two.select("u", "v", F.col("paths").cast("double").alias("p")).unionByName(three).groupBy("u", "v").agg(F.sum("p").alias("score"))
    elif name == "jaccardIndex":
        df = two.join(deg.select("u", F.col("k").alias("ki")), "u").join(deg.select(F.col("u").alias("v"), F.col("k").alias("kj")), "v")
        scores = df.select("u", "v", (F.col("paths") / F.greatest(F.col("ki") + F.col("kj") - F.col("paths"), F.lit(1)).cast("double")).alias("score"))
    else:
        scores = two.select("u", "v", F.col("paths").cast("double").alias("score"))
    scores = mask_edges(scores, sym)
    # Sums of doubles differ in their last bits by order; ranks must not.
    scores = scores.withColumn("score", F.round("score", 9))
    out = keep_top(scores.where("u <> v") if exclude_self else scores, k)
    return out.withColumn("score", F.col("score") / F.lit(float(total))) if name == "localRandomWalk" else out
