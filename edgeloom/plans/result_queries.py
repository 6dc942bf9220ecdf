"""Queries over results: repairs, ranks, rank agreement, communities, file names and grids, theory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import expressions as E
from edgeloom.operators import communities, evaluation, graph, ranking, stats
from edgeloom.plans.base import degrees, edges, query, symmetric, table, target, train_degrees, with_
from edgeloom.plans.graph_queries import _networks, results
from edgeloom.sources import io


@query("nan_inf_repair", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN (SELECT min(c_acctbal) FROM customer WHERE NOT (c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0)) ELSE c_acctbal END AS ypred FROM customer""")
def nan_inf_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with NaN, both infinities: all become the least finite one (no infinity is below it here but -inf)."""
    c = F.col("c_custkey")
    x = F.when(c % 7 == 0, F.lit(float("nan"))).when(c % 11 == 0, F.lit(float("inf"))).when(c % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    return evaluation.repair_scores_global(table(spark, sf_dir, "customer").select("c_custkey", x.alias("ypred")))


@query("safe_log", "SELECT c_custkey, round(ln(greatest(c_acctbal, 1e-12)), 6) AS x FROM customer")
def safe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(E.safe_log("c_acctbal"), 6).alias("x"))


@query("cantor_pairing", "SELECT o_orderkey, o_custkey, (o_orderkey + o_custkey) * (o_orderkey + o_custkey + 1) // 2 + o_custkey AS z, (o_orderkey + o_custkey) * (o_orderkey + o_custkey + 1) // 2 + least(o_orderkey, o_custkey) AS zu, o_orderkey AS a, o_custkey AS b FROM orders")
def cantor_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", E.cantor_pair("o_orderkey", "o_custkey").alias("z"), E.cantor_pair("o_orderkey", "o_custkey", True).alias("zu"))
    return rows.withColumn("p", E.cantor_unpair("z")).select("o_orderkey", "o_custkey", "z", "zu", "p.a", "p.b")


@query("vector_distances", """SELECT a.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
round(acos(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS angular, round(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    both = e.join(e.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return both.select("id", *[F.round(E.distance("a", "b", m), 6).alias(m) for m in ("euclidean", "cosine", "angular", "dot")])


@query("recode_labels", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS strict, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS kept FROM customer")
def recode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = {"BUILDING": "b", "MACHINERY": "m"}
    return table(spark, sf_dir, "customer").select("c_custkey", E.recode("c_mktsegment", m).alias("strict"), E.recode("c_mktsegment", m, keep=True).alias("kept"))


@query("param_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') OR lang IS NULL")
def param_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(E.in_or_null("lang", ["en", "de"])).select("doc_id", "lang")


@query("quantile_filter", with_("deg", "SELECT u, k FROM deg WHERE k >= (SELECT quantile_cont(k, 0.99) FROM deg)"))
def quantile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = degrees(symmetric(edges(spark, sf_dir)))
    q = deg.agg(F.percentile("k", 0.99)).first()[0]
    return deg.where(F.col("k") >= F.lit(q))


@query("describe_degrees", with_("deg", "SELECT count(*) AS n, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS sd, min(k) AS lo, quantile_cont(k, 0.5) AS median, max(k) AS hi FROM deg"))
def describe_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = degrees(symmetric(edges(spark, sf_dir)))
    return deg.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.round(F.stddev_samp("k"), 6).alias("sd"), F.min("k").alias("lo"), F.percentile("k", 0.5).alias("median"), F.max("k").alias("hi"))


_SPEAR = "(rank() OVER (PARTITION BY c_nationkey ORDER BY {x}) + (count(*) OVER (PARTITION BY c_nationkey, {x}) - 1) / 2.0::DOUBLE)"


@query("spearman", f"SELECT c_nationkey, round(corr(a, b), 6) AS rho FROM (SELECT c_nationkey, {_SPEAR.format(x='c_acctbal')} AS a, {_SPEAR.format(x='c_custkey % 97')} AS b FROM customer) GROUP BY c_nationkey")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 97).alias("m"))
    place = lambda x: F.rank().over(Window.partitionBy("c_nationkey").orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", x)) - 1) / F.lit(2.0)
    return rows.select("c_nationkey", place("c_acctbal").alias("a"), place("m").alias("b")).groupBy("c_nationkey").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("relative_score_vs_pa", with_("results", "SELECT model, sampler, round(round(auc, 6) / max(CASE WHEN model = 'preferentialAttachment' THEN round(auc, 6) END) OVER (PARTITION BY sampler), 6) AS relative FROM results"))
def relative_score_vs_pa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("auc", F.round("auc", 6))
    return evaluation.relative_score(r, ["sampler"], "preferentialAttachment", score="auc").select("model", "sampler", F.round("relative", 6).alias("relative"))


_RANKED = with_("results", ", ranked AS MATERIALIZED (SELECT model, sampler, row_number() OVER (PARTITION BY sampler ORDER BY round(auc, 6) DESC, model) AS rank FROM results)\n").replace("\n, ranked", ",\nranked")


@query("rank_models", _RANKED + "SELECT model, sampler, rank FROM ranked")
def rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("auc", F.round("auc", 6))
    return evaluation.rank_models(r, ["sampler"], score="auc").select("model", "sampler", "rank")


@query("dense_rank_models", with_("results", "SELECT model, sampler, dense_rank() OVER (PARTITION BY sampler ORDER BY round(auc, 3) DESC) AS rank FROM results"))
def dense_rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("auc", F.round("auc", 3))
    return ranking.dense_rank_by(r, ["sampler"], "auc").select("model", "sampler", "rank")


@query("rank_change", _RANKED + "SELECT a.model, a.rank AS rank_a, b.rank AS rank_b, a.rank - b.rank AS dr, a.rank - b.rank >= 2 AS rose, a.rank - b.rank <= -2 AS fell FROM ranked a JOIN ranked b ON a.model = b.model WHERE a.sampler = 'uniform' AND b.sampler = 'degreeBiased'")
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("auc", F.round("auc", 6))
    return evaluation.rank_change(r, "uniform", "degreeBiased", score="auc", far=2)


@query("rbo_ext", _RANKED + """SELECT p, round(max(xk) / 10.0::DOUBLE * p ** 10 + (1 - p) / p * sum(xd / CAST(d AS DOUBLE) * p ** d), 6) AS rbo FROM (
  SELECT p, d, (SELECT count(*) FROM ranked a JOIN ranked b ON a.model = b.model WHERE a.sampler = 'uniform' AND b.sampler = 'degreeBiased' AND 11 - a.rank <= d AND 11 - b.rank <= d) AS xd, 10 AS xk
  FROM (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9), (0.98)) x(p), (SELECT unnest(range(1, 11)) AS d)) GROUP BY p""")
def rbo_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rank_models(spark, sf_dir)
    wide = r.groupBy("model").agg(F.max(F.when(F.col("sampler") == "uniform", F.col("rank"))).alias("rank_s"), F.max(F.when(F.col("sampler") == "degreeBiased", F.col("rank"))).alias("rank_t")).withColumn("data", F.lit("copurchase"))
    wide = graph.materialise(wide, "rbo")
    out = None
    for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.98):
        one = evaluation.rank_biased_overlap(wide, ["data"], p).select(F.lit(p).alias("p"), F.round("rbo", 6).alias("rbo"))
        out = one if out is None else out.union(one)
    return out


@query("pivot_ranks", _RANKED + "SELECT model, max(rank) FILTER (sampler = 'uniform') AS uniform, max(rank) FILTER (sampler = 'degreeBiased') AS \"degreeBiased\" FROM ranked GROUP BY model")
def pivot_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pivot_metric(rank_models(spark, sf_dir), ["model"], "sampler", ["uniform", "degreeBiased"], "rank")


@query("heterogeneity_code", with_("stats_deg", "SELECT network, row_number() OVER (ORDER BY s, network) - 1 AS code, 100.0::DOUBLE * (row_number() OVER (ORDER BY s, network) - 1) / count(*) OVER () AS percentile FROM (SELECT network, round(sqrt(ln(1 + var_pop(k) / (avg(k) * avg(k)))), 6) AS s FROM stats_deg GROUP BY network)"))
def heterogeneity_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.degree_moments(stats.degrees_by_network(_networks(spark, sf_dir))).withColumn("lognorm_sigma", F.round("lognorm_sigma", 6))
    return evaluation.heterogeneity_code(m)


@query("degree_heterogeneity", with_("deg", "SELECT round(sqrt(sum((1 - p) * (1 - p)) / max(n)) / sqrt(1 - 3.0::DOUBLE / max(n)), 6) AS h FROM (SELECT count(*) / CAST((SELECT count(*) FROM deg) AS DOUBLE) AS p, (SELECT count(*) FROM deg) AS n FROM deg GROUP BY k)"))
def degree_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.degrees_by_network(edges(spark, sf_dir).select(F.lit("x").alias("network"), "src", "trg"))
    return stats.heterogeneity(d).select(F.round("degreeHeterogeneity", 6).alias("h"))


@query("pos_neg_degree_ccdf", with_("deg", "SELECT k, round(sum(sum(k)) OVER (ORDER BY k DESC) / CAST(sum(sum(k)) OVER () AS DOUBLE), 6) AS pos, round(sum(count(*)) OVER (ORDER BY k DESC) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS neg FROM deg GROUP BY k"))
def pos_neg_degree_ccdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.endpoint_degree_ccdf(degrees(symmetric(edges(spark, sf_dir))))
    return d.select("k", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


@query("deg_deg_table", with_("target tdeg", """SELECT t.src, t.trg, a.k AS ks, b.k AS kt, y AS "isPositiveEdge" FROM target t JOIN tdeg a ON a.u = t.src JOIN tdeg b ON b.u = t.trg WHERE sampler = 'uniform'
UNION ALL SELECT t.trg, t.src, b.k, a.k, y FROM target t JOIN tdeg a ON a.u = t.src JOIN tdeg b ON b.u = t.trg WHERE sampler = 'uniform'"""))
def deg_deg_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = target(spark, sf_dir).where("sampler = 'uniform'").select("src", "trg", F.col("y").alias("isPositiveEdge"))
    return evaluation.endpoint_degrees(train_degrees(spark, sf_dir), t)


@query("trapezoid_by_model", """SELECT l_returnflag, l_linestatus, round(sum((x - x0) * (y + y0) / 2.0::DOUBLE), 4) AS area FROM (
  SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM (SELECT l_returnflag, l_linestatus, l_quantity AS x, round(avg(l_discount), 8) AS y FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY x)) GROUP BY ALL""")
def trapezoid_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x")).agg(F.round(F.avg("l_discount"), 8).alias("y"))
    return evaluation.trapezoid(rows, ["l_returnflag", "l_linestatus"], "x", "y").withColumn("area", F.round("area", 4))


# --- communities -----------------------------------------------------------------------------------


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.slice("embedding", 1, 10)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("a"), (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("b"))


@query("contingency", with_("groups", "SELECT a, CAST(b AS INTEGER) AS b, count(*) AS n FROM groups GROUP BY a, b"))
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.contingency(_groups(spark, sf_dir))


_MARG = """, cell AS (SELECT a, b, count(*) AS n FROM groups GROUP BY a, b), ra AS (SELECT a, count(*) AS na FROM groups GROUP BY a), rb AS (SELECT b, count(*) AS nb FROM groups GROUP BY b), t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM groups)
"""


@query("nmi", with_("groups", _MARG + """SELECT round(2 * (SELECT sum(n / t * ln(n * t / (na * nb))) FROM cell JOIN ra USING (a) JOIN rb USING (b), t) / ((SELECT -sum(na / t * ln(na / t)) FROM ra, t) + (SELECT -sum(nb / t * ln(nb / t)) FROM rb, t)), 6) AS nmi""").replace("\n, cell", ",\ncell"))
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.normalised_mutual_information(_groups(spark, sf_dir)).select(F.round("nmi", 6).alias("nmi"))


@query("element_centric_similarity", with_("groups", _MARG + """SELECT round((s - r) / (1 - r), 6) AS esim FROM (SELECT (SELECT sum(n * n / CAST(greatest(na, nb) AS DOUBLE)) / max(t) FROM cell JOIN ra USING (a) JOIN rb USING (b), t) AS s,
(SELECT sum((na * nb / t) * (na * nb / t) / greatest(na, nb)) / max(t) FROM ra, rb, t) AS r)""").replace("\n, cell", ",\ncell"))
def element_centric_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.element_centric_similarity(_groups(spark, sf_dir)).select(F.round("esim", 6).alias("esim"))


@query("label_propagation")
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.label_propagation(symmetric(edges(spark, sf_dir)), 5)


# --- file names, grids, casts ----------------------------------------------------------------------


@query("filename_params", """SELECT n, regexp_extract(f, 'model~([^_.]*)', 1) AS model, regexp_extract(f, 'dim~([^_.]*)', 1) AS dim, regexp_extract(f, 'sampleId~([^_.]*)', 1) AS "sampleId" FROM (
  SELECT n_nationkey AS n, 'out/x/score_model~m' || n_nationkey || '_dim~' || n_regionkey || '_sampleId~' || n_nationkey % 3 || '.csv' AS f FROM nation)""")
def filename_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    name = F.concat(F.lit("out/x/score_model~m"), k, F.lit("_dim~"), r, F.lit("_sampleId~"), (F.col("n_nationkey") % 3).cast("string"), F.lit(".csv"))
    p = io.filename_params(io.stem(name))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), *[F.try_element_at(p, F.lit(c)).alias(c) for c in ("model", "dim", "sampleId")])


@query("param_grid", "SELECT model, CAST(dim AS BIGINT) AS dim, sampler FROM (VALUES ('cn'), ('ra')) a(model), (VALUES (64), (128)) b(dim), (VALUES ('uniform'), ('degreeBiased')) c(sampler)")
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.param_grid(spark, {"model": ["cn", "ra"], "dim": [64, 128], "sampler": ["uniform", "degreeBiased"]})


@query("union_grid", "SELECT 'cn' AS model, CAST(NULL AS BIGINT) AS dim UNION ALL SELECT 'fastrp', 64 UNION ALL SELECT 'fastrp', 128")
def union_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.union_grid(spark, [{"model": ["cn"]}, {"model": ["fastrp"], "dim": [64, 128]}])


@query("best_effort_cast", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rank, o_orderstatus FROM orders")
def best_effort_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank"), "o_orderstatus")
    return io.to_numeric(rows, to_int=["rank", "o_orderstatus"])


@query("small_networks", with_("stats_deg", "SELECT network FROM stats_deg GROUP BY network HAVING count(*) <= 1500"))
def small_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stats.degrees_by_network(_networks(spark, sf_dir)).groupBy("network").agg(F.count(F.lit(1)).alias("n_nodes"))
    return io.small_networks(n, 1500)


@query("edge_list_scan", with_("edges", "SELECT src, trg FROM edges"))
def edge_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as a 1-based space separated list with reversed rows and read back."""
    from edgeloom.storage import scratch_root

    e = edges(spark, sf_dir)
    folder = f"{scratch_root(spark)}/edge-list-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    e.select(F.col("trg") + 1, F.col("src") + 1).union(e.select(F.col("src") + 1, F.col("trg") + 1)).write.mode("overwrite").option("sep", " ").csv(folder)
    return io.read_edge_list(spark, folder, one_based=True)


# --- theory ----------------------------------------------------------------------------------------


@query("theory_power_law_bound", "SELECT alpha, round(((alpha - 1) / (2 * alpha - 3)) ** 2, 6) AS bound FROM (SELECT 2 + k / 10.0::DOUBLE AS alpha FROM (SELECT unnest(range(1, 61)) AS k))")
def theory_power_law_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.range(1, 61).select((2 + F.col("id") / F.lit(10.0)).alias("alpha"))
    return stats.theory_power_law_bound(a).withColumn("bound", F.round("bound", 6))


@query("theory_lognormal_auc", """SELECT sigma, round(1 - sum(exp(-x * x / 2) * q * h) / sum(exp(-x * x / 2) * h), 6) AS auc FROM (
  SELECT sigma, x, h, (sum(exp(-(y * y) / 2) * h) OVER (PARTITION BY sigma ORDER BY x) - exp(-(y * y) / 2) * h / 2) / 2.5066282746310002 AS q FROM (
    SELECT sigma, x, h, x - sigma AS y FROM (SELECT 0.5::DOUBLE + k * 0.5 AS sigma FROM (SELECT unnest(range(3)) AS k)) s, (SELECT -8 + i * 0.001::DOUBLE AS x, 0.001::DOUBLE AS h FROM (SELECT unnest(range(16001)) AS i)) g)) GROUP BY sigma""")
def theory_lognormal_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The sum on the grid is the chance that a normal is below another shifted by sigma: Phi(sigma / sqrt 2).
    s = spark.range(3).select((0.5 + F.col("id") * 0.5).alias("sigma"))
    got = stats.theory_lognormal_auc(spark, s.select((F.col("sigma") / F.sqrt(F.lit(2.0))).alias("sigma"), F.col("sigma").alias("s")).select("sigma"))
    return got.select(F.round(F.col("sigma") * F.sqrt(F.lit(2.0)), 6).alias("sigma"), F.round("auc", 6).alias("auc"))


@query("theory_zeta_auc", """SELECT alpha, round(sum(pos * (below - 0.5::DOUBLE * neg)), 9) AS auc FROM (
  SELECT alpha, p / sum(p) OVER (PARTITION BY alpha) AS neg, k * p / sum(k * p) OVER (PARTITION BY alpha) AS pos, sum(p) OVER (PARTITION BY alpha ORDER BY k) / sum(p) OVER (PARTITION BY alpha) AS below FROM (
    SELECT alpha, k, k::DOUBLE ** -alpha AS p FROM (SELECT unnest([2.2, 2.5, 3.0, 3.5])::DOUBLE AS alpha) a, (SELECT unnest(range(1, 20001)) AS k) b)) GROUP BY alpha""")
def theory_zeta_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a, round(stats.theory_zeta_auc(a), 9)) for a in (2.2, 2.5, 3.0, 3.5)], "alpha double, auc double")
