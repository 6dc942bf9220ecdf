"""Statistics of networks: one grouped job for any number of them, keyed by ``network``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.storage import materialise


def _sym(edges: DataFrame) -> DataFrame:
    back = edges.where("src <> trg").select("network", F.col("trg").alias("u"), F.col("src").alias("v"))
    return edges.select("network", F.col("src").alias("u"), F.col("trg").alias("v")).unionAll(back)


def degrees_by_network(edges: DataFrame) -> DataFrame:
    return _sym(edges).groupBy("network", "u").agg(F.count(F.lit(1)).alias("k"))


def local_triangles(edges: DataFrame) -> DataFrame:
    """(network, u, t): triangles at each node; edges point from lower to higher degree first."""
    plain = edges.where("src <> trg")
    deg = degrees_by_network(plain)
    e = plain.join(deg.select("network", F.col("u").alias("src"), F.col("k").alias("ks")), ["network", "src"]).join(deg.select("network", F.col("u").alias("trg"), F.col("k").alias("kt")), ["network", "trg"])
    up = (F.col("ks") < F.col("kt")) | ((F.col("ks") == F.col("kt")) & (F.col("src") < F.col("trg")))
    out = materialise(e.select("network", F.when(up, F.col("src")).otherwise(F.col("trg")).alias("x"), F.when(up, F.col("trg")).otherwise(F.col("src")).alias("y")), "oriented")
    wedge = out.join(out.withColumnRenamed("y", "z"), ["network", "x"]).where("y < z")
    shut = wedge.join(plain.select("network", F.col("src").alias("y"), F.col("trg").alias("z")), ["network", "y", "z"], "left_semi")
    return shut.select("network", F.explode(F.array("x", "y", "z")).alias("u")).groupBy("network", "u").agg(F.count(F.lit(1)).alias("t"))


def degree_moments(deg: DataFrame) -> DataFrame:
    """Means and biased moments of degrees, excess kurtosis, log-normal fit by moments."""
    k = F.col("k").cast("double")
    base = deg.groupBy("network").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("k").alias("total"), F.avg(k).alias("averageDegree"), F.max("k").alias("maxDegree"),
        F.kurtosis(k).alias("degreeKurtosis"), F.skewness(k).alias("degreeSkewness"), F.var_pop(k).alias("degreeVariance"),
    )
    n, var, mean = F.col("n_nodes"), F.col("degreeVariance"), F.col("averageDegree")
    m = F.floor(F.col("total") / 2)
    density = F.col("total") / (n * (n - 1)).cast("double")
    spread = 1 + var / (mean * mean)
    return base.select(
        "*", ((n - 1) * var / (n * m * (1 - density))).alias("degreeVariance_normalized"),
        (mean / F.sqrt(spread)).alias("lognorm_mu"), F.sqrt(F.log(spread)).alias("lognorm_sigma"),
    )


def heterogeneity(deg: DataFrame) -> DataFrame:
    each = deg.groupBy("network", "k").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy("network"))
    p = each.select("network", n.alias("n"), (F.col("c") / n.cast("double")).alias("p"))
    h = p.groupBy("network").agg(F.max("n").alias("n"), F.sum((1 - F.col("p")) * (1 - F.col("p"))).alias("s"))
    return h.select("network", (F.sqrt(F.col("s") / F.col("n")) / F.sqrt(1 - F.lit(3.0) / F.col("n"))).alias("degreeHeterogeneity"))


def assortativity(edges: DataFrame, deg: DataFrame) -> DataFrame:
    s = _sym(edges).join(deg.select("network", "u", F.col("k").alias("ku")), ["network", "u"]).join(deg.select("network", F.col("u").alias("v"), F.col("k").alias("kv")), ["network", "v"])
    return s.groupBy("network").agg(F.corr(F.col("ku").cast("double"), F.col("kv").cast("double")).alias("degreeAssortativity"))


def transitivity(deg: DataFrame, tri: DataFrame) -> DataFrame:
    """Global transitivity and the mean local one over nodes with two neighbours or more."""
    d = deg.join(tri, ["network", "u"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    w = F.col("k") * (F.col("k") - 1) / F.lit(2.0)
    return d.groupBy("network").agg((F.sum("t") / F.sum(w)).alias("globalTransitivity"), F.avg(F.when(F.col("k") >= 2, F.col("t") / w)).alias("localTransitivity"))


def network_stats(edges: DataFrame, n_rows: DataFrame | None = None) -> DataFrame:
    """15 columns a network. ``edges``: (network, src, trg) canonical; ``n_rows`` (network, n_edges)
    gives the files' row counts where they differ from the distinct edges."""
    edges = materialise(edges, "stats-edges")
    deg = materialise(degrees_by_network(edges), "stats-degrees")
    n_edges = edges.groupBy("network").agg(F.count(F.lit(1)).alias("n_edges")) if n_rows is None else n_rows
    out = degree_moments(deg).join(n_edges, "network")
    for part in (assortativity(edges, deg), transitivity(deg, local_triangles(edges)), heterogeneity(deg)):
        out = out.join(part, "network", "left")
    return out.select(
        "network", "n_nodes", "n_edges", "averageDegree", "maxDegree", "degreeKurtosis", "degreeSkewness", "degreeVariance", "degreeVariance_normalized",
        "degreeAssortativity", "globalTransitivity", "localTransitivity", "degreeHeterogeneity", "lognorm_mu", "lognorm_sigma",
    )


def power_law_fit(deg: DataFrame) -> DataFrame:
    """(alpha, xmin, ks): maximum likelihood exponent for each candidate xmin, the one with least distance.

    Works on the degree distribution, whose rows are the distinct degrees.
    """
    d = deg.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("k > 0")
    pairs = d.select(F.col("k").alias("xmin")).join(d, F.col("k") >= F.col("xmin"))
    fit = pairs.groupBy("xmin").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("k") / (F.col("xmin") - 0.5))).alias("s"))
    fit = fit.select("xmin", "n", (1 + F.col("n") / F.col("s")).alias("alpha"))
    w = Window.partitionBy("xmin").orderBy("k")
    cdf = pairs.join(fit, "xmin").withColumn("emp", F.sum("c").over(w) / F.col("n"))
    gap = F.abs(F.col("emp") - (1 - F.pow((F.col("k") + 0.5) / (F.col("xmin") - 0.5), 1 - F.col("alpha"))))
    ks = cdf.groupBy("xmin", "alpha").agg(F.max(gap).alias("ks"))
    return ks.orderBy("ks", "xmin").limit(1).select("alpha", "xmin", "ks")


def theory_lognormal_auc(spark, sigmas: DataFrame, points: int = 10_000) -> DataFrame:
    """(sigma, auc): preferential attachment on log-normal degrees; the integral has the closed form Phi(sigma)."""
    from edgeloom.functions.expressions import normal_cdf

    return sigmas.select("sigma", normal_cdf(F.col("sigma")).alias("auc"))


def theory_power_law_bound(exponents: DataFrame) -> DataFrame:
    a = F.col("alpha")
    return exponents.select("alpha", F.pow((a - 1) / (2 * a - 3), F.lit(2.0)).alias("bound"))


def theory_zeta_auc(alpha: float, terms: int = 20_000) -> float:
    """AUC of degree ranking when P(k) falls as k**-alpha: edge ends against uniform nodes, ties half."""
    import numpy as np

    k = np.arange(1, terms + 1, dtype=float)
    neg = k**-alpha
    neg /= neg.sum()
    pos = k * neg
    pos /= pos.sum()
    below = np.concatenate([[0.0], np.cumsum(neg)[:-1]])
    return float((pos * (below + 0.5 * neg)).sum())
