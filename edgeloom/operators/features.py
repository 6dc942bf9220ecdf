"""Node and pair features for the stacked classifier, centralities, folds and the forest itself."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.operators import around, blocks, spectral
from edgeloom.operators.graph import degrees, hop_distances, triangle_counts, upper_triangle
from edgeloom.operators.scorers import score_pairs
from edgeloom.operators.walks import ball_rows
from edgeloom.storage import materialise, shuffle_width


def pagerank(sym: DataFrame, rounds: int = 20, alpha: float = 0.85) -> DataFrame:
    """(u, pr) after a fixed number of rounds from the uniform start; every node here has a neighbour."""
    deg = materialise(degrees(sym), "pr-degrees")
    n = max(deg.count(), 1)
    sym = materialise(sym, "pr-graph")
    x = deg.select("u", "k", F.lit(1.0 / n).alias("x"))
    for i in range(rounds):
        got = x.select("u", (F.col("x") / F.col("k")).alias("y")).join(sym, "u").groupBy(F.col("v").alias("u")).agg(F.sum("y").alias("y"))
        x = got.join(deg, "u").select("u", "k", (F.lit((1 - alpha) / n) + F.lit(alpha) * F.col("y")).alias("x"))
        if i % 4 == 3:
            x = materialise(x, "pr")
    return x.select("u", F.col("x").alias("pr"))


def personalised_pagerank(sym: DataFrame, seeds: DataFrame, rounds: int = 20, alpha: float = 0.85) -> DataFrame:
    """(s, u, ppr): only the seeds' (node) own walks are kept."""
    shared = around.held(sym) if rounds else None
    if shared is not None:
        return ball_rows(shared, seeds, rounds, 1 - alpha, alpha, "s long, u long, ppr double")
    deg = materialise(degrees(sym), "ppr-degrees")
    sym = materialise(sym, "ppr-graph")
    start = seeds.select(F.col("node").alias("s"), F.col("node").alias("u"), F.lit(1 - alpha).alias("x"))
    x = start.withColumn("x", F.lit(1.0))
    for _ in range(rounds):
        step = x.join(deg, "u").select("s", "u", (F.lit(alpha) * F.col("x") / F.col("k")).alias("y")).join(sym, "u").select("s", F.col("v").alias("u"), F.col("y").alias("x"))
        x = materialise(step.unionByName(start).groupBy("s", "u").agg(F.sum("x").alias("x")), "ppr")
    return x.select("s", "u", F.col("x").alias("ppr"))


def eigenvector_centrality(sym: DataFrame, rounds: int = 20) -> DataFrame:
    """(u, ec): power steps of A + I, divided by the L2 norm at the end of each."""
    sym = materialise(sym, "ec-graph")
    x = materialise(degrees(sym).select("u", F.lit(1.0).alias("x")), "ec")
    for _ in range(rounds):
        y = sym.join(x, "u").select(F.col("v").alias("u"), "x").unionByName(x).groupBy("u").agg(F.sum("x").alias("y"))
        y = materialise(y, "ec")
        size = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        x = y.select("u", (F.col("y") / F.lit(size)).alias("x"))
    return x.select("u", F.col("x").alias("ec"))


def katz_centrality(sym: DataFrame, alpha: float = 0.1, beta: float = 1.0, max_nodes: int = 5000) -> DataFrame:
    """(u, katz): the solution of the linear system, normalised; above ``max_nodes`` found by products with
    the neighbour lists, to a residual of 1e-10, and not from a dense matrix."""
    g = large_graph(sym, max_nodes)
    if g is None:
        ids, a = dense(sym, max_nodes)
        x = np.linalg.solve(np.eye(len(ids)) - alpha * a, np.full(len(ids), beta))
    else:
        slots = around.Slots(g)
        ids, x = g.ids, spectral.solve(lambda x: x - alpha * slots.around(x[:, None])[:, 0], np.full(len(g.ids), beta))
    x = x / np.linalg.norm(x) * np.sign(x.sum() or 1)
    return sym.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(ids, x)], "u long, katz double")


def large_graph(sym: DataFrame, max_nodes: int) -> around.Graph | None:
    """Neighbour lists of a graph of over ``max_nodes`` nodes, None for a smaller one."""
    if sym.select("u").distinct().count() <= max_nodes:
        return None
    shared = around.held(sym)
    if shared is None:
        raise ValueError(f"the driver holds the graph, which is done for at most {around.MAX_ENDS} edge ends")
    return shared.value


def dense(sym: DataFrame, max_nodes: int) -> tuple[list[int], np.ndarray]:
    """Ids and dense matrix of a small graph on the driver; the bound is checked before anything moves."""
    n = sym.select("u").distinct().count()
    if n > max_nodes:
        raise ValueError(f"{n} nodes; a dense matrix is made for at most {max_nodes}")
    rows = sym.collect()
    ids = sorted({r["u"] for r in rows})
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((n, n))
    for r in rows:
        a[at[r["u"]], at[r["v"]]] = 1.0
    return ids, a


def closeness(sym: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, cc): closeness by breadth-first search from each source, scaled by the share it reaches.

    The search ends when nothing new is reached, or after ``most`` hops. If every node of the graph is a
    source, tasks that hold it search 64 sources a word; else, or on a larger graph, by joins.
    """
    sym = materialise(sym, "cc-graph")
    n = sym.select("u").distinct().count()
    known = sources.join(sym.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select("node").distinct().count()
    shared = around.held(sym) if known == n == sources.count() else None
    if shared is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = shared.value
            for nodes in _numbers(batches, 1024):
                # Distances go both ways: what a block's nodes are away from each node, summed over blocks.
                t, r = around.levels(g, nodes, most)
                at = np.flatnonzero(r)
                yield pa.RecordBatch.from_arrays([pa.array(g.ids[at]), pa.array(t[at]), pa.array(r[at])], ["s", "t", "r"])

        per = _source_numbers(sym, n, 1024).mapInArrow(run, "s long, t long, r long").groupBy("s").agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
        per = sources.select(F.col("node").alias("s")).join(per, "s", "left")
        t, r = F.coalesce("t", F.lit(0)), F.coalesce("r", F.lit(0))
        return per.select(F.col("s").alias("node"), F.when(t > 0, r / t.cast("double") * r / F.lit(float(max(n - 1, 1)))).otherwise(0.0).alias("cc"))
    front = materialise(sources.select(F.col("node").alias("s"), "node", F.lit(0).alias("d")), "cc")
    seen, before, d = front, None, 0
    while most is None or d < most:
        d += 1
        step = front.join(sym.select(F.col("u").alias("node"), "v"), "node").select("s", F.col("v").alias("node")).distinct()
        # Neighbours of a level are on it, next to it or new.
        for known in (front, before):
            step = step if known is None else step.join(known.select("s", "node"), ["s", "node"], "left_anti")
        before, front = front, materialise(step.withColumn("d", F.lit(d)), "cc")
        if front.isEmpty():
            break
        seen = seen.union(front)
    per = seen.groupBy("s").agg(F.sum("d").alias("t"), (F.count(F.lit(1)) - 1).alias("r"))
    value = F.when(F.col("t") > 0, F.col("r") / F.col("t").cast("double") * F.col("r") / F.lit(float(max(n - 1, 1)))).otherwise(0.0)
    return per.select(F.col("s").alias("node"), value.alias("cc"))


def _source_numbers(sym: DataFrame, n: int, block: int) -> DataFrame:
    """Node numbers (id), a few blocks a partition: late tasks stay short."""
    return sym.sparkSession.range(0, n, 1, max(shuffle_width(sym.sparkSession), min(-(-n // block), 512)))


def _numbers(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[np.ndarray]:
    for b in batches:
        every = b.column("id").to_numpy()
        for at in range(0, len(every), block):
            yield every[at : at + block]


def betweenness(sym: DataFrame, max_ends: int = around.MAX_ENDS, load: bool = False) -> DataFrame:
    """(u, bc): normalised betweenness (or load). Sources are spread over tasks, and a block of them is
    searched at once, within each biconnected part of the graph alone (``blocks``); each task has the whole adjacency,
    so the graph's size is checked first."""
    shared = around.held(sym, max_ends)
    if shared is None:
        raise ValueError(f"every task holds the graph, which is done for at most {max_ends} edge ends")
    n, spark = len(shared.value.ids), sym.sparkSession
    found = blocks.Blocks(shared.value)
    # Sources of one block that are searched at once: a search may meet all edge ends in one step. A block of two
    # nodes has nothing between them.
    ends = np.diff(np.concatenate([[0], np.cumsum(shared.value.k[found.members])])[found.at])
    steps = np.maximum(1, np.minimum(around.BLOCK // np.maximum(found.sizes(), 1), 3 * around.BLOCK // np.maximum(ends, 1)))
    works = [(b, at, at + step) for b, (m, step) in enumerate(zip(found.sizes().tolist(), steps.tolist())) if m > 2 for at in range(0, m, step)]
    sent = spark.sparkContext.broadcast(around.Arrays(found.at, found.members, found.weight, np.array(works, dtype=np.int64).reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, (starts, members, weight, works) = shared.value, sent.value.arrays
        total, last, works = np.zeros(n), -1, works.reshape(-1, 3)
        for batch in batches:
            for b, at, to in works[batch.column("id").to_numpy()].tolist():
                if b != last:
                    nodes = slice(starts[b], starts[b + 1])
                    own, last = blocks.part(g, members[nodes]), b
                total[own.ids] += around.flows(own, np.arange(at, min(to, len(own.ids))), load, weight[nodes])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.ids[some]), pa.array(total[some])], ["u", "b"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids[i]), pa.array(crossing.value[i])], ["u", "b"])

    crossing = spark.sparkContext.broadcast(found.crossing)
    width = max(1, min(len(works), max(shuffle_width(spark), 512)))
    out = spark.range(0, len(works), 1, width).mapInArrow(run, "u long, b double").unionAll(spark.range(0, n, 1, max(1, min(n // 100_000, 512))).mapInArrow(between, "u long, b double"))
    scale = float(max((n - 1) * (n - 2), 1))
    return out.groupBy("u").agg((F.sum("b") / F.lit(scale)).alias("bc"))


def node_features(sym: DataFrame, rounds: int = 20) -> DataFrame:
    """(u, k, deg_cent, triangles, clust, ave_neigh_deg, pr, ec) of every node with an edge."""
    deg = materialise(degrees(sym), "feature-degrees")
    n = deg.count()
    tri = triangle_counts(upper_triangle(sym))
    around = sym.join(deg.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").groupBy("u").agg(F.avg("kv").alias("ave_neigh_deg"))
    out = deg.join(tri, "u", "left").join(around, "u", "left").join(pagerank(sym, rounds), "u").join(eigenvector_centrality(sym, rounds), "u")
    t = F.coalesce("t", F.lit(0))
    return out.select("u", "k", (F.col("k") / F.lit(float(max(n - 1, 1)))).alias("deg_cent"), t.alias("triangles"), F.when(F.col("k") > 1, 2.0 * t / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clust"), "ave_neigh_deg", "pr", "ec")


def pair_features(sym: DataFrame, pairs: DataFrame, hops: int | None = None) -> DataFrame:
    """Local features of (src, trg) pairs; one score column each, short_path null without a path (of ``hops`` at most, if given)."""
    deg = materialise(degrees(sym), "pair-degrees")
    out = pairs.select("src", "trg").distinct()
    for column, name in (("com_ne", "commonNeighbors"), ("jacc_coeff", "jaccardIndex"), ("res_alloc_ind", "resourceAllocation"), ("adam_adar", "adamicAdarTextbook"), ("pref_attach", "preferentialAttachment"), ("LHN", "leichtHolmeNewman")):
        out = out.join(score_pairs(name, sym, deg, pairs.select("src", "trg").distinct()).withColumnRenamed("score", column), ["src", "trg"])
    direct = sym.select(F.col("u").alias("src"), F.col("v").alias("trg"), F.lit(1).alias("svd_edges"))
    out = out.join(direct, ["src", "trg"], "left").withColumn("svd_edges", F.coalesce("svd_edges", F.lit(0)))
    out = out.join(deg.select(F.col("u").alias("trg"), "k"), "trg", "left")
    out = out.withColumns({"svd_edges_dot": F.col("com_ne"), "svd_edges_mean": F.when(F.col("k") > 0, F.col("com_ne") / F.col("k")).otherwise(0.0)}).drop("k")
    return out.join(hop_distances(sym, pairs, hops).withColumnRenamed("hops", "short_path"), ["src", "trg"], "left")


#: Bytes of vectors that the driver sends at once.
SENT = 48_000_000


def _held_svd_features(shared: Broadcast, pairs: DataFrame) -> DataFrame:
    """From the vectors alone: an entry is a product of two rows, and a mean over neighbours, as these are
    eigenvectors, one of the square over the degree. One task finds the vectors, with an executor's memory; some
    at a time are sent to all tasks, which add their share to each pair."""
    spark, n = pairs.sparkSession, len(shared.value.ids)
    take = int(np.ceil(np.sqrt(n)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            s, u = spectral.filtered_eigen(around.Near(shared.value).around, n, take)
            for j in range(take):
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([s[j]]), pa.array([u[:, j].tobytes()], pa.binary())], ["j", "s", "x"])

    found = materialise(spark.range(0, 1, 1, 1).mapInArrow(vectors, "j long, s double, x binary"), "svd-vectors")
    names = ["svd_edges_approx", "svd_edges_dot_approx", "svd_edges_mean_approx"]
    schema = "src long, trg long, " + ", ".join(f"{x} double" for x in names)
    rows = pairs.select(F.col("src").cast("long"), F.col("trg").cast("long"), *[F.lit(0.0).alias(x) for x in names])
    step = max(1, SENT // (8 * n))
    for lo in range(0, take, step):
        part = found.where(F.col("j").between(lo, lo + step - 1)).toArrow()
        u = np.stack([np.frombuffer(x.as_buffer()) for x in part.column("x")], axis=1)
        sent = spark.sparkContext.broadcast((part.column("s").to_numpy(), u))
        del part, u

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            g, (s, u) = shared.value, sent.value
            for b in batches:
                i, j = (g.number(b[c]) for c in ("src", "trg"))
                ok = (i >= 0) & (j >= 0)
                out, j = b[ok].copy(), j[ok]
                both = u[i[ok]] * u[j]
                for column, by in zip(names, (both @ s, both @ s**2, both @ s**2 / np.maximum(g.k[j], 1))):
                    out[column] += by
                yield out

        rows = materialise(rows.mapInPandas(run, schema), "svd-pairs")
        sent.destroy()
    return rows


def approximate_svd_features(sym: DataFrame, pairs: DataFrame, max_nodes: int = 5000) -> DataFrame:
    """svd_edges_approx, _dot and _mean: entries of the rank-ceil(sqrt(n)) approximation of the matrix."""
    g = large_graph(sym, max_nodes)
    if g is not None:
        return _held_svd_features(around.held(sym), pairs)
    ids, a = dense(sym, max_nodes)
    u, s, vt = np.linalg.svd(a)
    keep = int(np.ceil(np.sqrt(len(ids))))
    low = (u[:, :keep] * s[:keep]) @ vt[:keep]
    at = {x: i for i, x in enumerate(ids)}
    shared = pairs.sparkSession.sparkContext.broadcast((at, a, low))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, a, low = shared.value
        for b in batches:
            i, j = (np.array([at.get(x, -1) for x in b[c]]) for c in ("src", "trg"))
            ok = (i >= 0) & (j >= 0)
            rows = b[ok].copy()
            i, j = i[ok], j[ok]
            rows["svd_edges_approx"], rows["svd_edges_dot_approx"] = low[i, j], (low[i] * low[j]).sum(axis=1)
            rows["svd_edges_mean_approx"] = [low[x][a[y] > 0].mean() if a[y].any() else 0.0 for x, y in zip(i, j)]
            yield rows

    return pairs.select("src", "trg").mapInPandas(run, "src long, trg long, svd_edges_approx double, svd_edges_dot_approx double, svd_edges_mean_approx double")


def recode_sentinels(rows: DataFrame, path: str = "short_path", diameter: str | None = None) -> DataFrame:
    """A missing path becomes 1000 times the longest, a missing diameter a million."""
    longest = rows.agg(F.max(path)).first()[0] or 0
    out = rows.withColumn(path, F.coalesce(F.col(path), F.lit(1000 * longest)))
    return out.withColumn(diameter, F.coalesce(F.col(diameter), F.lit(1e6))) if diameter else out


def impute_mean(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN become the column's mean."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    means = rows.agg(*[F.avg(number(c)).alias(c) for c in columns]).first()
    return rows.withColumns({c: F.coalesce(number(c), F.lit(means[c]).cast("double")) for c in columns})


def stratified_folds(rows: DataFrame, label: str, key: Column, folds: int = 5) -> DataFrame:
    """fold 1..folds, each with equal shares of every class; order within a class by an integer key."""
    return rows.withColumn("fold", F.ntile(folds).over(Window.partitionBy(label).orderBy(key)))


def oversample(rows: DataFrame, label: str, key: Column) -> DataFrame:
    """Every class repeated, in key order and round again, up to the largest one's number."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(counts.values(), default=0)
    n = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v))])
    i = (F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1).cast("long")
    out = rows.withColumn("__i", i).withColumn("__n", F.element_at(n, F.col(label)))
    times = F.floor(F.lit(most) / F.col("__n")) + F.when(F.col("__i") < F.lit(most) % F.col("__n"), 1).otherwise(0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).drop("__i", "__n")


def forest_grid(rows: DataFrame, features: Sequence[str], depths=(3, 6), trees=(25, 50, 100), positive: int = 1, seed: int = 0) -> DataFrame:
    """(depth, trees, f1) of each setting: mean F1 over folds; rows have y, fold and features."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from edgeloom.operators.evaluation import confusion

    data = materialise(VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select("y", "fold", "features"), "forest")
    folds = [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]
    out = []
    for d in depths:
        for t in trees:
            scores = []
            for f in folds:
                model = RandomForestClassifier(labelCol="y", maxDepth=d, numTrees=t, seed=seed).fit(data.where(F.col("fold") != f))
                said = model.transform(data.where(F.col("fold") == f)).select((F.col("y") == positive).cast("int").alias("y"), (F.col("prediction") == positive).cast("int").alias("pred"))
                scores.append(confusion(said).first()["f1"])
            out.append((d, t, float(np.mean(scores))))
    return rows.sparkSession.createDataFrame(out, "depth int, trees int, f1 double").orderBy(F.desc("f1"), "depth", "trees")


def forest_held_out(train: DataFrame, test: DataFrame, features: Sequence[str], depth: int = 6, trees: int = 50, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(y, ypred, pred) of the held-out rows, and (feature, importance)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    put = VectorAssembler(inputCols=list(features), outputCol="features")
    model = RandomForestClassifier(labelCol="y", maxDepth=depth, numTrees=trees, seed=seed).fit(put.transform(train))
    said = model.transform(put.transform(test)).select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("ypred"), F.col("prediction").cast("int").alias("pred"))
    shares = [(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())]
    return said, train.sparkSession.createDataFrame(shares, "feature string, importance double")


def calibrated(valid: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores through a one-feature logistic regression that is fitted on validation rows (y, score)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    put = VectorAssembler(inputCols=["score"], outputCol="x")
    model = LogisticRegression(featuresCol="x", labelCol="y").fit(put.transform(valid))
    return scores.withColumn("score", 1.0 / (1.0 + F.exp(-(F.lit(float(model.coefficients[0])) * F.col("score") + F.lit(float(model.intercept))))))
