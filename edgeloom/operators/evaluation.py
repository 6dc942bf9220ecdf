"""Scores of scores: AUC, average precision, retrieval, rank agreement, communities, confusion.

Counts per distinct score replace sorting rows, and one cumulative window runs over those counts.
Many (data, sampler, model) combinations are columns in ``by``: one job evaluates the whole grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def repair_scores(scores: DataFrame, by: Sequence[str] = (), column: str = "ypred") -> DataFrame:
    """NaN and null become the least score that is one; then any infinity the least finite score."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = F.col(column)
    number = x.isNotNull() & ~F.isnan(x)
    one = scores.withColumn("__low", F.min(F.when(number, x)).over(w)).withColumn(column, F.when(number, x).otherwise(F.col("__low")))
    finite = F.abs(F.col(column)) != F.lit(float("inf"))
    two = one.withColumn("__fin", F.min(F.when(finite, F.col(column))).over(w)).withColumn(column, F.when(finite, F.col(column)).otherwise(F.col("__fin")))
    return two.drop("__low", "__fin")


def repair_scores_global(scores: DataFrame, column: str = "ypred") -> DataFrame:
    """The same for one table of any size: two scalars instead of windows."""
    x = F.col(column)
    number = x.isNotNull() & ~F.isnan(x)
    row = scores.agg(F.min(F.when(number, x)).alias("low"), F.min(F.when(number & (F.abs(x) != F.lit(float("inf"))), x)).alias("fin")).first()
    filled = F.when(number, x).otherwise(F.lit(row["low"]).cast("double"))
    return scores.withColumn(column, F.when(F.abs(filled) == F.lit(float("inf")), F.lit(row["fin"]).cast("double")).otherwise(filled))


def _levels(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by, "ypred").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("n"))


def _over(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def auc_roc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with half credit for ties, a row for each group of ``by``."""
    below = F.coalesce(F.sum("n").over(_over(by).orderBy("ypred").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = _levels(scores, by).withColumn("c", F.col("p") * (below + F.lit(0.5) * F.col("n")))
    return part.groupBy(*by).agg((F.sum("c") / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"))


def average_precision(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    up = _over(by).orderBy(F.desc("ypred")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = _levels(scores, by).withColumns({"tp": F.sum("p").over(up), "all": F.sum(F.col("p") + F.col("n")).over(up)})
    return part.groupBy(*by).agg((F.sum(F.col("p") * F.col("tp") / F.col("all").cast("double")) / F.sum("p")).alias("ap"))


def retrieval(topk: DataFrame, test: DataFrame, ks: Sequence[int] = (5, 10, 25, 50, 100), bidirectional: bool = False) -> DataFrame:
    """(topk, prec, rec): means over nodes with a test edge; all cut-offs in one pass."""
    want = test.select(F.col("src").alias("u"), F.col("trg").alias("v"))
    if bidirectional:
        want = want.union(test.select("trg", "src"))
    want = want.distinct()
    n = want.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    hits = topk.join(want, ["u", "v"]).groupBy("u").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    per = n.join(hits, "u", "left")
    each = [F.struct(F.lit(k).alias("topk"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("h")) for k in ks]
    rows = per.select("n", F.explode(F.array(*each)).alias("e"))
    return rows.groupBy(F.col("e.topk").alias("topk")).agg(F.avg(F.col("e.h") / F.col("e.topk").cast("double")).alias("prec"), F.avg(F.col("e.h") / F.col("n").cast("double")).alias("rec"))


def retrieval_micro(topk: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """Sums over focal nodes: hits over predictions, hits over test edges."""
    want = test.select(F.col("src").alias("u"), F.col("trg").alias("v")).distinct()
    mine = topk.where(F.col("rank") <= k).join(want.select("u").distinct(), "u", "left_semi")
    hit = mine.join(want.withColumn("hit", F.lit(1)), ["u", "v"], "left")
    got = hit.agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("made"))
    all_of = want.agg(F.count(F.lit(1)).alias("tests"))
    return got.join(all_of, F.lit(True)).select((F.col("hits") / F.col("made").cast("double")).alias("prec"), (F.col("hits") / F.col("tests").cast("double")).alias("rec"))


def rank_models(results: DataFrame, by: Sequence[str], score: str = "score", model: str = "model") -> DataFrame:
    """Rank from 1, best first, in each group; ties by name."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), model)).cast("long"))


def rank_change(results: DataFrame, a: str, b: str, key: str = "sampler", score: str = "score", model: str = "model", far: int = 8) -> DataFrame:
    """(model, rank_a, rank_b, dr, rose, fell): mean ranks' order under two settings."""
    mean = results.groupBy(key, model).agg(F.avg(score).alias("m"))
    ranked = mean.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("m"), model)).cast("long"))
    wide = ranked.groupBy(model).agg(F.max(F.when(F.col(key) == a, F.col("r"))).alias("rank_a"), F.max(F.when(F.col(key) == b, F.col("r"))).alias("rank_b"))
    dr = F.col("rank_a") - F.col("rank_b")
    return wide.select(model, "rank_a", "rank_b", dr.alias("dr"), (dr >= far).alias("rose"), (dr <= -far).alias("fell"))


def relative_score(results: DataFrame, by: Sequence[str], baseline: str, score: str = "score", model: str = "model") -> DataFrame:
    base = F.max(F.when(F.col(model) == baseline, F.col(score))).over(Window.partitionBy(*by))
    return results.withColumn("relative", F.col(score) / base)


def rank_biased_overlap(lists: DataFrame, by: Sequence[str], p: float, worst_first: bool = True) -> DataFrame:
    """Extrapolated RBO of two full rankings of the same models: rows (by..., model, rank_s, rank_t).

    An item is in both prefixes from depth max(rank) on; overlaps are one cumulative sum.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    place = lambda c: (n + 1 - F.col(c)) if worst_first else F.col(c)
    rows = lists.withColumn("k", n).withColumn("d", F.greatest(place("rank_s"), place("rank_t")))
    depth = rows.groupBy(*by, "k", "d").agg(F.count(F.lit(1)).alias("x"))
    # Depths where nothing enters still count: fill 1..k.
    every = rows.select(*by, "k").distinct().withColumn("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    full = every.join(depth, [*by, "k", "d"], "left").withColumn("x", F.coalesce("x", F.lit(0)))
    over = full.withColumn("xd", F.sum("x").over(Window.partitionBy(*by).orderBy("d")))
    term = F.col("xd") / F.col("d").cast("double") * F.pow(F.lit(p), F.col("d").cast("double"))
    out = over.groupBy(*by).agg(F.max("k").alias("k"), F.max("xd").alias("xk"), F.sum(term).alias("s"))
    return out.select(*by, (F.col("xk") / F.col("k").cast("double") * F.pow(F.lit(p), F.col("k").cast("double")) + F.lit((1 - p) / p) * F.col("s")).alias("rbo"))


def contingency(a_b: DataFrame) -> DataFrame:
    return a_b.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def normalised_mutual_information(a_b: DataFrame) -> DataFrame:
    """One row ``nmi``, normalised by the mean of both entropies."""
    c = contingency(a_b)
    total = Window.partitionBy(F.lit(0))
    cells = c.select("n", F.sum("n").over(Window.partitionBy("a")).alias("na"), F.sum("n").over(Window.partitionBy("b")).alias("nb"), F.sum("n").over(total).cast("double").alias("t"))
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb").cast("double"))))
    # A cell's share of its row's entropy: n of the row's n_a members.
    ha = -F.sum(F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t")))
    hb = -F.sum(F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("t")))
    s = cells.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"))
    return s.select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def element_centric_similarity(a_b: DataFrame) -> DataFrame:
    """One row ``esim``: similarity of two partitions, corrected for that of independent ones."""
    c = contingency(a_b)
    total = c.agg(F.sum("n")).first()[0] or 0
    na = c.groupBy("a").agg(F.sum("n").alias("na"))
    nb = c.groupBy("b").agg(F.sum("n").alias("nb"))
    t = F.lit(float(total))
    both = c.join(na, "a").join(nb, "b")
    s = both.agg((F.sum(F.col("n") * F.col("n") / F.greatest("na", "nb").cast("double")) / t).alias("s"))
    # Expectation over all pairs of blocks: sizes repeat, so pairs of distinct sizes with their numbers.
    ca, cb = na.groupBy("na").agg(F.count(F.lit(1)).alias("ca")), nb.groupBy("nb").agg(F.count(F.lit(1)).alias("cb"))
    e = F.col("na") * F.col("nb") / t
    r = ca.join(cb, F.lit(True)).agg((F.sum(F.col("ca") * F.col("cb") * e * e / F.greatest("na", "nb").cast("double")) / t).alias("r"))
    return s.join(r, F.lit(True)).select(((F.col("s") - F.col("r")) / (1 - F.col("r"))).alias("esim"))


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 for class 1 of (y, pred) rows."""
    is_ = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    c = rows.groupBy(*by).agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b.cast("double")).otherwise(0.0)
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def trapezoid(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Integral of y over x in each group, points in order of x."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / F.lit(2.0)
    return rows.withColumn("__p", part).groupBy(*by).agg(F.sum("__p").alias("area"))


def heterogeneity_code(stats: DataFrame, column: str = "lognorm_sigma", name: str = "network") -> DataFrame:
    """Networks coded 0..n-1 by heterogeneity, and as a share of 100."""
    code = (F.row_number().over(Window.orderBy(column, name)) - 1).cast("long")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return stats.select(name, code.alias("code"), (F.lit(100.0) * code / n).alias("percentile"))


def endpoint_degrees(deg: DataFrame, target: DataFrame) -> DataFrame:
    """Both ends' degrees of each target pair, both ways round."""
    one = target.join(deg.select(F.col("u").alias("src"), F.col("k").alias("ks")), "src").join(deg.select(F.col("u").alias("trg"), F.col("k").alias("kt")), "trg")
    return one.select("src", "trg", "ks", "kt", "isPositiveEdge").unionAll(one.select("trg", "src", "kt", "ks", "isPositiveEdge"))


def endpoint_degree_ccdf(deg: DataFrame) -> DataFrame:
    """(k, pos, neg): share of ends with a degree of k or more, for ends of edges and for uniform nodes."""
    d = deg.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    every, up = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    share = lambda c: F.sum(c).over(up) / F.sum(c).over(every).cast("double")
    return d.select("k", share(F.col("k") * F.col("n")).alias("pos"), share(F.col("n")).alias("neg"))


def hard_negatives(scores: DataFrame) -> DataFrame:
    """The positives, and as many of the best scored negatives."""
    n = scores.where("y = 1").count()
    return scores.where("y = 1").unionByName(scores.where("y = 0").orderBy(F.desc("ypred"), "src", "trg").limit(n))


def pivot_metric(rows: DataFrame, by: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).pivot(column, list(values)).agg(F.max(value))


def lda_separation(groups: DataFrame) -> Column:
    """AUC folded to at least one half."""
    return F.greatest(F.col("auc"), 1 - F.col("auc"))
