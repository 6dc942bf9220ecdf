"""Queries over graphs: core, split, negatives, scores, retrieval, statistics, features, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import communities, embedding, evaluation, features, generators, graph, ranking, sampling, scorers, split, stats, walks
from edgeloom.operators.dataset import LinkPredictionDataset
from edgeloom.plans import base
from edgeloom.plans.base import edges, query, sparse_edges, table, target, test_edges, train_degrees, train_edges, train_sym, user_edges, with_
from edgeloom.storage import materialise, scratch_root


# --- core ------------------------------------------------------------------------------------------


@query("edges_canonical", with_("edges", "SELECT src, trg FROM edges"))
def edges_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query("edges_symmetric", with_("sym", "SELECT u, v FROM sym"))
def edges_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetric(edges(spark, sf_dir))


@query("upper_triangle", with_("sym", "SELECT u AS src, v AS trg FROM sym WHERE u < v"))
def upper_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upper_triangle(graph.symmetric(edges(spark, sf_dir)), strict=True)


@query("weighted_edges", """SELECT l_partkey AS r, l_suppkey AS c, round(sum(l_quantity), 6) AS v FROM lineitem GROUP BY ALL HAVING sum(l_quantity) >= 30""")
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weighted_edges(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), 30.0).withColumn("v", F.round("v", 6))


@query("degree", with_("deg", "SELECT u, k FROM deg"))
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.symmetric(edges(spark, sf_dir)))


@query("degree_distribution", with_("deg", "SELECT k, count(*) AS n FROM deg GROUP BY k"))
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_distribution(degree(spark, sf_dir))


@query("reindex_nodes", with_("deg", "SELECT row_number() OVER (ORDER BY u) - 1 AS id, u AS old FROM deg"))
def reindex_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reindex(edges(spark, sf_dir))[1]


_REACH = "reach(node, label) AS (SELECT DISTINCT u, u FROM ssym UNION SELECT s.v, r.label FROM reach r JOIN ssym s ON s.u = r.node WHERE r.label < s.v)"
_COMPS = "comps AS (SELECT node, min(label) AS component FROM reach GROUP BY node)"


@query("connected_components", with_("ssym", "").rstrip() + f",\n{_REACH},\n{_COMPS} SELECT node, component FROM comps")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(sparse_edges(spark, sf_dir)).select("node", "component")


@query("giant_component", with_("ssym", "").rstrip() + f""",\n{_REACH},\n{_COMPS} SELECT src, trg FROM sparse JOIN comps ON node = src
WHERE component = (SELECT component FROM comps GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)""")
def giant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.giant_component(sparse_edges(spark, sf_dir))


@query("bfs_levels", with_("lvl", "SELECT node, level FROM lvl"))
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = graph.symmetric(edges(spark, sf_dir))
    return graph.bfs_levels(sym, sym.agg(F.min("u").alias("node")))


@query("spanning_forest", with_("tree", "SELECT src, trg FROM tree"))
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.spanning_forest(edges(spark, sf_dir))


@query("spanning_forest_size", with_("tree deg", "SELECT (SELECT count(*) FROM deg) AS n_nodes, (SELECT count(*) FROM tree) AS n_tree"))
def spanning_forest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = degree(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(graph.spanning_forest(edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_tree")), F.lit(True))


@query("triangles", with_("edges", "SELECT a.src AS a, a.trg AS b, b.trg AS c FROM edges a JOIN edges b ON b.src = a.trg JOIN edges c ON c.src = a.src AND c.trg = b.trg"))
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(edges(spark, sf_dir))


@query("neighbour_sums", with_("usym", "SELECT a.u, b.v, count(*) AS paths FROM usym a JOIN usym b ON b.u = a.v GROUP BY a.u, b.v"))
def neighbour_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_sums(graph.symmetric(user_edges(spark, sf_dir)))


@query("row_normalise", "SELECT l_orderkey AS u, l_linenumber AS v, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS p FROM lineitem")
def row_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_linenumber").alias("v"), F.col("l_quantity").alias("w"))
    return graph.row_normalise(rows).withColumn("p", F.round("p", 9))


@query("running_probability", with_("usym udeg", """SELECT s.u, s.v, round(CASE WHEN row_number() OVER w = d.k THEN 1.0::DOUBLE ELSE row_number() OVER w / d.k::DOUBLE END, 9) AS cum
FROM usym s JOIN udeg d ON d.u = s.u WINDOW w AS (PARTITION BY s.u ORDER BY s.v)"""))
def running_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = graph.symmetric(user_edges(spark, sf_dir)).withColumn("w", F.lit(1.0))
    return graph.running_probability(graph.row_normalise(sym)).select("u", "v", F.round("cum", 9).alias("cum"))


@query("roulette_pick", with_("usym udeg", """SELECT d.u AS draw, d.u, s.v FROM udeg d JOIN (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS i FROM usym) s
ON s.u = d.u AND s.i = (d.u * 7919 + 13) % d.k"""))
def roulette_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = graph.symmetric(user_edges(spark, sf_dir))
    cum = graph.running_probability(graph.row_normalise(sym.withColumn("w", F.lit(1.0))))
    draws = graph.degrees(sym).select("u", F.col("u").alias("draw"), (((F.col("u") * 7919 + 13) % F.col("k") + 0.5) / F.col("k")).alias("r"))
    return graph.roulette_pick(cum, draws)


# --- split and negatives ---------------------------------------------------------------------------


@query("train_test_split", with_("test train", "SELECT 'test' AS split, src, trg FROM test UNION ALL SELECT 'train', src, trg FROM train"))
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = test_edges(spark, sf_dir), train_edges(spark, sf_dir)
    return a.select(F.lit("test").alias("split"), "src", "trg").union(b.select(F.lit("train"), "src", "trg"))


@query("train_test_split_tolerant", with_("tree edges", """, free AS (SELECT src, trg, row_number() OVER (ORDER BY (src*73856093 + trg*19349663) % 1000003, src, trg) AS r, count(*) OVER () AS n
FROM edges e WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.src = e.src AND t.trg = e.trg))
SELECT src, trg FROM free WHERE r <= floor(0.5::DOUBLE * n / (SELECT count(*) FROM edges) * n)""").replace("\n, free", ",\nfree"))
def train_test_split_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.held_out(edges(spark, sf_dir), 0.95, tolerant=True)[0]


@query("nested_hold_out")
def nested_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.nested_hold_out(edges(spark, sf_dir), 0.2)
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), "src", "trg")
        out = one if out is None else out.union(one)
    return out


@query("negatives_uniform", with_("neg_u", "SELECT src, trg, draw FROM neg_u"))
def negatives_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.uniform(spark, sf_dir)


@query("negatives_degree_biased", with_("neg_b", "SELECT src, trg, draw FROM neg_b"))
def negatives_degree_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.biased(spark, sf_dir)


@query("negatives_multi", with_("neg_u neg_u2", "SELECT CAST(0 AS INTEGER) AS nth, src, trg FROM neg_u UNION ALL SELECT 1, src, trg FROM neg_u2"))
def negatives_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = base.uniform(spark, sf_dir).select(F.lit(0).alias("nth"), "src", "trg")
    return one.union(base.negative_edges(spark, sf_dir, False, seed=1000).select(F.lit(1), "src", "trg"))


@query("negatives_with_duplicates")
def negatives_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with fewer non-edges than are asked for: the rest repeats accepted pairs."""
    e = user_edges(spark, sf_dir)
    population = materialise(sampling.stubs(graph.symmetric(e), False), "stubs")
    n = population.count()
    # As many as there are pairs: more than there are non-edges, whatever the graph.
    return sampling.negatives(population, e, n * (n - 1) // 2, max_rounds=3, pad=True)


@query("all_negatives", with_("usym", "SELECT a.u AS src, b.u AS trg FROM (SELECT DISTINCT u FROM usym) a JOIN (SELECT DISTINCT u FROM usym) b ON a.u < b.u WHERE NOT EXISTS (SELECT 1 FROM usym s WHERE s.u = a.u AND s.v = b.u)"))
def all_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_edges(spark, sf_dir)
    return sampling.all_negatives(e, graph.symmetric(e).select(F.col("u").alias("id")).distinct())


@query("sample_nodes", with_("stub_b", """SELECT d AS draw, s.node FROM (SELECT unnest(range(1000)) AS d) q JOIN stub_b s
ON s.i = ((d*2+1)*48271 % 2147483647) * 16807 % 2147483647 % (SELECT count(*) FROM stub_b)"""))
def sample_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_nodes(materialise(sampling.stubs(train_sym(spark, sf_dir), True), "stubs"), 1000)


@query("group_sample", "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey * 48271 % 2147483647) AS r FROM orders) WHERE r <= 100")
def group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return sampling.group_sample(rows, "o_orderstatus", F.col("o_orderkey") * 48271 % 2147483647, 100)


@query("sbm_sample")
def sbm_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = train_sym(spark, sf_dir)
    member = sym.select(F.col("u").alias("node")).distinct().select("node", (F.col("node") % 5).alias("g"))
    return sampling.sbm_sample(sym, member, 1000)


@query("labelled_pairs")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("label"))
    return sampling.labelled_pairs(labels, 500)


@query("target_edge_table", with_("target", "SELECT sampler, src, trg, y AS \"isPositiveEdge\" FROM target"))
def target_edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target(spark, sf_dir).withColumnRenamed("y", "isPositiveEdge")


@query("target_both_directions", with_("target", "SELECT sampler, src, trg, y FROM target UNION ALL SELECT sampler, trg, src, y FROM target"))
def target_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.both_directions(target(spark, sf_dir)).select("sampler", "src", "trg", "y")


@query("dataset_facade")
def dataset_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = LinkPredictionDataset(test_edge_fraction=0.2, negatives_per_positive=2).fit(edges(spark, sf_dir))
    return made.transform()[1]


# --- scores ----------------------------------------------------------------------------------------

_SHORT = {"pa": "preferentialAttachment", "log_pa": "logPreferentialAttachment", "cn": "commonNeighbors", "jaccard": "jaccardIndex", "ra": "resourceAllocation", "aa": "adamicAdar", "aa_textbook": "adamicAdarTextbook", "lhn": "leichtHolmeNewman", "lrw": "localRandomWalk", "lpi": "localPathIndex"}


def scored(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """Target rows with a model's score on the training graph; each distinct pair is scored once."""
    key = (spark.sparkContext.applicationId, sf_dir, f"scored-{model}")
    if key not in base._MADE:
        pairs = target(spark, sf_dir).select("src", "trg").distinct()
        base._MADE[key] = materialise(scorers.score_models([model], train_sym(spark, sf_dir), pairs).withColumnRenamed(model, "score"), "scored")
    return target(spark, sf_dir).join(base._MADE[key], ["src", "trg"])


def _score_query(short: str, model: str) -> None:
    # Digits count from the largest score's: path scores are small.
    digits = 9 if short == "lrw" else 6

    @query(f"score_{short}", with_("scored", f"SELECT src, trg, round(score, {digits}) AS score FROM scored WHERE model = '{model}'"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(spark, sf_dir, model).select("src", "trg", F.round("score", digits).alias("score")).distinct()


for _s, _m in _SHORT.items():
    _score_query(_s, _m)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, sampler, auc) of all models, in one evaluation of target rows that are scored where they are."""
    names = list(_SHORT.values())
    wide = scorers.score_models(names, train_sym(spark, sf_dir), target(spark, sf_dir))
    # A model's number moves, not its name.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.round(x, 9).alias("ypred")) for i, x in enumerate(names)]))
    got = evaluation.auc_roc(wide.select("sampler", "y", each.alias("e")).select("e.m", "sampler", "y", "e.ypred"), ["m", "sampler"])
    return got.select(F.get(F.array(*map(F.lit, names)), F.col("m")).alias("model"), "sampler", "auc")


@query("auc_by_sampler", with_("target ends", """SELECT sampler, round(sum(p * (below + 0.5::DOUBLE * n)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 9) AS auc FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY sampler ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT t.sampler, e.ki * e.kj AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM target t JOIN ends e ON e.src = t.src AND e.trg = t.trg GROUP BY ALL)) GROUP BY sampler"""))
def auc_by_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, "preferentialAttachment").withColumnRenamed("score", "ypred")
    return evaluation.auc_roc(rows, ["sampler"]).withColumn("auc", F.round("auc", 9))


@query("auc_by_model_sampler", with_("results", "SELECT model, sampler, round(auc, 6) AS auc FROM results"))
def auc_by_model_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).withColumn("auc", F.round("auc", 6))


@query("average_precision", with_("target scored", """SELECT sampler, round(sum(p * tp / CAST(al AS DOUBLE)) / sum(p), 6) AS ap FROM (
  SELECT *, sum(p) OVER w AS tp, sum(p + n) OVER w AS al FROM (
    SELECT t.sampler, s.score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM target t JOIN scored s ON s.src = t.src AND s.trg = t.trg AND s.model = 'commonNeighbors' GROUP BY ALL)
  WINDOW w AS (PARTITION BY sampler ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY sampler"""))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, "commonNeighbors").withColumnRenamed("score", "ypred")
    return evaluation.average_precision(rows, ["sampler"]).withColumn("ap", F.round("ap", 6))


@query("confusion_f1", with_("target ends", """SELECT sampler, tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS "precision", round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM (
  SELECT sampler, count(*) FILTER (y = 1 AND ki * kj >= 100) AS tp, count(*) FILTER (y = 0 AND ki * kj >= 100) AS fp, count(*) FILTER (y = 1 AND ki * kj < 100) AS fn, count(*) FILTER (y = 0 AND ki * kj < 100) AS tn
  FROM target t JOIN ends e ON e.src = t.src AND e.trg = t.trg GROUP BY sampler)"""))
def confusion_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, "preferentialAttachment").withColumn("pred", (F.col("score") >= 100).cast("int"))
    c = evaluation.confusion(rows, ["sampler"])
    return c.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@query("hard_negatives", with_("target ends", """SELECT src, trg, y, s AS ypred FROM (SELECT t.src, t.trg, y, CAST(ki * kj AS DOUBLE) AS s, row_number() OVER (PARTITION BY y ORDER BY ki * kj DESC, t.src, t.trg) AS r
  FROM target t JOIN ends e ON e.src = t.src AND e.trg = t.trg WHERE sampler = 'uniform') WHERE y = 1 OR r <= (SELECT count(*) FROM test)"""))
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, "preferentialAttachment").where("sampler = 'uniform'").select("src", "trg", "y", F.col("score").alias("ypred"))
    return evaluation.hard_negatives(rows)


# --- retrieval -------------------------------------------------------------------------------------

_MASK = "NOT EXISTS (SELECT 1 FROM tsym t WHERE t.u = c.u AND t.v = c.v)"
_TOP = "SELECT u, v, score, r AS rank FROM (SELECT u, v, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS r FROM (SELECT c.u, c.v, round(c.score, 9) AS score FROM ({c}) c WHERE " + _MASK + ")) WHERE r <= {k}"
_CANDIDATES = {
    "cn": "SELECT u, v, CAST(count(*) AS DOUBLE) AS score FROM wedge GROUP BY u, v",
    "jaccard": "SELECT w.u, w.v, n / CAST(greatest(a.k + b.k - n, 1) AS DOUBLE) AS score FROM (SELECT u, v, count(*) AS n FROM wedge GROUP BY u, v) w JOIN tdeg a ON a.u = w.u JOIN tdeg b ON b.u = w.v",
    "ra": "SELECT w.u, w.v, sum(1.0::DOUBLE / d.k) AS score FROM wedge w JOIN tdeg d ON d.u = w.z GROUP BY w.u, w.v",
    "aa": "SELECT w.u, w.v, sum(1.0::DOUBLE / greatest(ln(d.k), 1.0)) AS score FROM wedge w JOIN tdeg d ON d.u = w.z GROUP BY w.u, w.v",
    "lpi": "SELECT u, v, sum(p) AS score FROM (SELECT u, v, CAST(count(*) AS DOUBLE) AS p FROM wedge GROUP BY u, v UNION ALL SELECT q.u, s.v, q.n * 0.001::DOUBLE FROM (SELECT u, v, count(*) AS n FROM wedge GROUP BY u, v) q JOIN tsym s ON s.u = q.v) GROUP BY u, v",
    "lrw": "SELECT u, v, sum(p) AS score FROM (SELECT u, v, 1.0::DOUBLE AS p FROM tsym UNION ALL SELECT u, v, p FROM two UNION ALL SELECT q.u, s.v, q.p / d.k FROM two q JOIN tdeg d ON d.u = q.v JOIN tsym s ON s.u = q.v) GROUP BY u, v",
}


def _top_query(short: str) -> None:
    model = _SHORT[short]
    body = _TOP.format(c=_CANDIDATES[short], k=10)
    if short == "lrw":
        body = ",\ntwo AS MATERIALIZED (SELECT w.u, w.v, sum(1.0::DOUBLE / d.k) AS p FROM wedge w JOIN tdeg d ON d.u = w.z GROUP BY w.u, w.v)\n" + body
    sql = with_("wedge tdeg", body).replace("\n,\n", ",\n").replace("SELECT u, v, score, r AS rank", "SELECT u, v, r AS rank", 1)

    @query(f"topk_{short}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sym = train_sym(spark, sf_dir)
        # Path scores have the degrees in the graph that the tasks hold.
        deg = graph.degrees(sym) if short in ("lpi", "lrw") else train_degrees(spark, sf_dir)
        return scorers.top_k(model, sym, deg, 10).select("u", "v", "rank")


for _s in _CANDIDATES:
    _top_query(_s)


@query("topk_pa", with_("tdeg", "SELECT t.u, b.u AS v, b.r AS rank FROM tdeg t, (SELECT u, row_number() OVER (ORDER BY k DESC, u) AS r FROM tdeg) b WHERE b.r <= 10"))
def topk_pa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.top_k("preferentialAttachment", train_sym(spark, sf_dir), train_degrees(spark, sf_dir), 10).select("u", "v", "rank")


_RETRIEVED = with_("wedge tdeg test", ",\ntopk AS MATERIALIZED (" + _TOP.format(c=_CANDIDATES["ra"], k=100) + ")\n").replace("\n,\n", ",\n").rstrip()


@query("precision_recall_at_k", _RETRIEVED + """ SELECT CAST(kk AS INTEGER) AS topk, round(avg(h / CAST(kk AS DOUBLE)), 6) AS prec, round(avg(h / CAST(n AS DOUBLE)), 6) AS rec FROM (
  SELECT q.src, kk, q.n, (SELECT count(*) FROM topk t JOIN test e ON e.src = t.u AND e.trg = t.v WHERE t.u = q.src AND t.rank <= kk) AS h
  FROM (SELECT src, count(*) AS n FROM test GROUP BY src) q, (VALUES (5), (10), (25), (50), (100)) x(kk)) GROUP BY kk""")
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scorers.top_k("resourceAllocation", train_sym(spark, sf_dir), train_degrees(spark, sf_dir), 100)
    got = evaluation.retrieval(top, test_edges(spark, sf_dir))
    return got.withColumns({"prec": F.round("prec", 6), "rec": F.round("rec", 6)})


@query("precision_recall_micro", _RETRIEVED + """ SELECT round((SELECT count(*) FROM topk t JOIN test e ON e.src = t.u AND e.trg = t.v WHERE t.rank <= 10)
  / CAST((SELECT count(*) FROM topk t WHERE t.rank <= 10 AND t.u IN (SELECT src FROM test)) AS DOUBLE), 6) AS prec,
  round((SELECT count(*) FROM topk t JOIN test e ON e.src = t.u AND e.trg = t.v WHERE t.rank <= 10) / CAST((SELECT count(*) FROM test) AS DOUBLE), 6) AS rec""")
def precision_recall_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scorers.top_k("resourceAllocation", train_sym(spark, sf_dir), train_degrees(spark, sf_dir), 100)
    return evaluation.retrieval_micro(top, test_edges(spark, sf_dir)).select(F.round("prec", 6).alias("prec"), F.round("rec", 6).alias("rec"))


@query("ranking_candidates", with_("wedge tdeg", "SELECT u, v, r AS rank FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS r FROM (SELECT c.u, c.v, count(*) AS n FROM wedge c WHERE c.u <> c.v AND " + _MASK + " GROUP BY c.u, c.v)) WHERE r <= 10"))
def ranking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking driver for every node."""
    deg = train_degrees(spark, sf_dir)
    return ranking.rank_by_topology("commonNeighbors", train_sym(spark, sf_dir), deg, deg.select("u"), 10).select("u", "v", "rank")


_KNN = """SELECT u, v, r AS rank FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) AS r FROM (
  SELECT a.vec_id AS u, b.vec_id AS v, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + {bonus}, 9) AS s FROM embeddings a, embeddings b)) WHERE r <= 10"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


@query("knn_inner_product", _KNN.format(bonus="0"))
def knn_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return ranking.knn_inner_product(e, e, 10).select("u", "v", "rank")


@query("knn_degree_augmented", _KNN.format(bonus="ln(1 + b.vec_id % 7)"))
def knn_degree_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).withColumn("bonus", F.log((1 + F.col("id") % 7).cast("double")))
    return ranking.knn_inner_product(e, e, 10, "bonus").select("u", "v", "rank")


@query("embedding_score", "SELECT a.vec_id AS src, b.vec_id AS trg, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).select("id", "vec")
    pairs = e.select(F.col("id").alias("src"), (F.col("id") + 1).alias("trg"))
    return embedding.score_by_dot(e, pairs).withColumn("score", F.round("score", 6))


# --- statistics ------------------------------------------------------------------------------------


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, get in (("copurchase", edges), ("sparse", sparse_edges), ("users", user_edges)):
        one = get(spark, sf_dir).select(F.lit(name).alias("network"), "src", "trg")
        out = one if out is None else out.union(one)
    return out


_STATS = """, m AS (SELECT network, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, avg(k) AS mean, max(k) AS most, var_pop(k) AS var FROM stats_deg GROUP BY network),
z AS (SELECT d.network, avg(((k - mean) / sqrt(var)) ** 3) AS skew, avg(((k - mean) / sqrt(var)) ** 4) - 3 AS kurt FROM stats_deg d JOIN m USING (network) GROUP BY d.network),
ass AS (SELECT s.network, corr(a.k, b.k) AS r FROM stats_sym s JOIN stats_deg a ON a.network = s.network AND a.u = s.u JOIN stats_deg b ON b.network = s.network AND b.u = s.v GROUP BY s.network),
tri AS (SELECT a.network, a.u, count(*) / 2 AS t FROM stats_sym a JOIN stats_sym b ON b.network = a.network AND b.u = a.v JOIN stats_sym c ON c.network = a.network AND c.u = a.u AND c.v = b.v GROUP BY a.network, a.u),
tr AS (SELECT d.network, sum(coalesce(t, 0)) / sum(k * (k - 1) / 2) AS g, avg(CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1) / 2) END) AS l FROM stats_deg d LEFT JOIN tri ON tri.network = d.network AND tri.u = d.u GROUP BY d.network),
h AS (SELECT network, sqrt(sum((1 - p) * (1 - p)) / max(n)) / sqrt(1 - 3.0::DOUBLE / max(n)) AS h FROM (SELECT q.network, c / CAST(n AS DOUBLE) AS p, n FROM (SELECT network, k, count(*) AS c FROM stats_deg GROUP BY network, k) q JOIN m USING (network)) GROUP BY network)
SELECT m.network, n AS n_nodes, (SELECT count(*) FROM stats_edges e WHERE e.network = m.network) AS n_edges, round(mean, 6) AS "averageDegree", most AS "maxDegree", round(kurt, 6) AS "degreeKurtosis", round(skew, 6) AS "degreeSkewness",
round(var, 6) AS "degreeVariance", round((n - 1) * var / (n * CAST(floor(total / 2) AS DOUBLE) * (1 - total / CAST(n * (n - 1) AS DOUBLE))), 6) AS "degreeVariance_normalized", round(r, 6) AS "degreeAssortativity",
round(g, 6) AS "globalTransitivity", round(l, 6) AS "localTransitivity", round(h, 6) AS "degreeHeterogeneity", round(mean / sqrt(1 + var / (mean * mean)), 6) AS lognorm_mu, round(sqrt(ln(1 + var / (mean * mean))), 6) AS lognorm_sigma
FROM m JOIN z USING (network) JOIN ass USING (network) JOIN tr USING (network) JOIN h USING (network)"""


@query("network_stats", with_("stats_deg", _STATS).replace("\n, m AS", ",\nm AS"))
def network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.network_stats(_networks(spark, sf_dir))
    return got.withColumns({c: F.round(c, 6) for c, t in got.dtypes if t == "double"})


@query("local_clustering", with_("users usym udeg", """SELECT d.u, coalesce(t, 0) AS t, round(CASE WHEN d.k > 1 THEN coalesce(t, 0) / (d.k * (d.k - 1) / 2) ELSE 0 END, 6) AS clust FROM udeg d LEFT JOIN (
  SELECT a.u, CAST(count(*) / 2 AS BIGINT) AS t FROM usym a JOIN usym b ON b.u = a.v JOIN usym c ON c.u = a.u AND c.v = b.v GROUP BY a.u) q ON q.u = d.u"""))
def local_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_edges(spark, sf_dir)
    d = graph.degrees(graph.symmetric(e)).join(graph.triangle_counts(e), "u", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return d.select("u", "t", F.round(F.when(F.col("k") > 1, 2.0 * F.col("t") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0), 6).alias("clust"))


@query("assortativity", with_("stats_deg", "SELECT s.network, round(corr(a.k, b.k), 6) AS \"degreeAssortativity\" FROM stats_sym s JOIN stats_deg a ON a.network = s.network AND a.u = s.u JOIN stats_deg b ON b.network = s.network AND b.u = s.v GROUP BY s.network"))
def assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _networks(spark, sf_dir)
    return stats.assortativity(e, stats.degrees_by_network(e)).withColumn("degreeAssortativity", F.round("degreeAssortativity", 6))


@query("lognormal_moments", with_("stats_deg", "SELECT network, round(m / sqrt(1 + v / (m * m)), 6) AS lognorm_mu, round(sqrt(ln(1 + v / (m * m))), 6) AS lognorm_sigma FROM (SELECT network, avg(k) AS m, var_pop(k) AS v FROM stats_deg GROUP BY network)"))
def lognormal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.degree_moments(stats.degrees_by_network(_networks(spark, sf_dir)))
    return got.select("network", F.round("lognorm_mu", 6).alias("lognorm_mu"), F.round("lognorm_sigma", 6).alias("lognorm_sigma"))


@query("power_law_fit")
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.power_law_fit(degree(spark, sf_dir))


# --- features --------------------------------------------------------------------------------------


@query("pagerank_20_iters", with_("usym udeg", """, pr(i, u, x) AS (SELECT 0, u, 1.0::DOUBLE / (SELECT count(*) FROM udeg) FROM udeg
  UNION ALL SELECT i + 1, s.v, 0.15::DOUBLE / (SELECT count(*) FROM udeg) + 0.85::DOUBLE * sum(x / d.k) FROM pr JOIN udeg d ON d.u = pr.u JOIN usym s ON s.u = pr.u WHERE i < 20 GROUP BY i, s.v)
SELECT u, round(x, 6) AS pr FROM pr WHERE i = 20""").replace("\n, pr", ",\npr"))
def pagerank_20_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pagerank(graph.symmetric(user_edges(spark, sf_dir)), 20).withColumn("pr", F.round("pr", 6))


@query("eigen_centrality_20_iters", with_("usym udeg", """, loop AS MATERIALIZED (SELECT u, v FROM usym UNION ALL SELECT u, u FROM udeg),
ec(i, u, x) AS (SELECT 0, u, 1.0::DOUBLE FROM udeg UNION ALL SELECT i + 1, s.v, sum(x) FROM ec JOIN loop s ON s.u = ec.u WHERE i < 20 GROUP BY i, s.v)
SELECT u, round(x / sqrt(sum(x * x) OVER ()), 6) AS ec FROM ec WHERE i = 20""").replace("\n, loop", ",\nloop"))
def eigen_centrality_20_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.eigenvector_centrality(graph.symmetric(user_edges(spark, sf_dir)), 20).withColumn("ec", F.round("ec", 6))


_HOPS = """, hop(s, node, d) AS (SELECT DISTINCT src, src, 0 FROM sample UNION SELECT h.s, t.v, h.d + 1 FROM hop h JOIN tsym t ON t.u = h.node WHERE h.d < {most})"""


# The search ends when nothing new is reached; its SQL needs a bound: the farthest pair of sf0.01 is 6 hops apart.
@query("short_path", with_("test tsym", ",\nsample AS MATERIALIZED (SELECT src, trg FROM test)" + _HOPS.format(most=8) + ",\nnear AS (SELECT s, node, min(d) AS d FROM hop GROUP BY s, node)\nSELECT src, trg, d AS hops FROM sample LEFT JOIN near ON s = src AND node = trg").replace("\n,\n", ",\n"))
def short_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of every held-out pair in the training graph, null only if no path joins them."""
    return graph.hop_distances(train_sym(spark, sf_dir), test_edges(spark, sf_dir))


@query("closeness", with_("usym udeg", """, hop(s, node, d) AS (SELECT u, u, 0 FROM udeg UNION SELECT h.s, t.v, h.d + 1 FROM hop h JOIN usym t ON t.u = h.node WHERE h.d < 30),
near AS (SELECT s, node, min(d) AS d FROM hop GROUP BY s, node)
SELECT s AS node, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / CAST(sum(d) AS DOUBLE) * (count(*) - 1) / CAST((SELECT count(*) FROM udeg) - 1 AS DOUBLE) ELSE 0 END, 6) AS cc FROM near GROUP BY s""").replace("\n, hop", ",\nhop"))
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness of every node over all that it reaches."""
    sym = graph.symmetric(user_edges(spark, sf_dir))
    return features.closeness(sym, graph.degrees(sym).select(F.col("u").alias("node"))).withColumn("cc", F.round("cc", 6))


@query("betweenness")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.betweenness(graph.symmetric(user_edges(spark, sf_dir)))


@query("katz_centrality")
def katz_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.katz_centrality(graph.symmetric(user_edges(spark, sf_dir)))


@query("node_features")
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.node_features(graph.symmetric(user_edges(spark, sf_dir)))


@query("personalised_pagerank", with_("usym udeg", """, pp(i, s, u, x) AS (SELECT 0, u, u, 1.0::DOUBLE FROM udeg UNION ALL
SELECT i, s, u, sum(x) FROM (SELECT i + 1 AS i, pp.s, t.v AS u, 0.85::DOUBLE * x / d.k AS x FROM pp JOIN udeg d ON d.u = pp.u JOIN usym t ON t.u = pp.u WHERE i < 10
  UNION ALL SELECT DISTINCT i + 1, s, s, 0.15::DOUBLE FROM pp WHERE i < 10) GROUP BY i, s, u)
SELECT s, u, round(x, 9) AS ppr FROM pp WHERE i = 10""").replace("\n, pp", ",\npp"))
def personalised_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = graph.symmetric(user_edges(spark, sf_dir))
    return features.personalised_pagerank(sym, graph.degrees(sym).select(F.col("u").alias("node")), 10).withColumn("ppr", F.round("ppr", 9))


@query("pair_features_local", with_("near ends", """SELECT e.src, e.trg, CAST(n.cn AS DOUBLE) AS com_ne, round(n.cn / CAST(greatest(e.ki + e.kj - n.cn, 1) AS DOUBLE), 6) AS jacc_coeff, round(n.ra, 6) AS res_alloc_ind, round(n.aat, 6) AS adam_adar,
CAST(e.ki * e.kj AS DOUBLE) AS pref_attach, round(n.cn / CAST(e.ki * e.kj AS DOUBLE), 6) AS "LHN" FROM ends e JOIN near n ON n.src = e.src AND n.trg = e.trg"""))
def pair_features_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = target(spark, sf_dir).select("src", "trg").distinct()
    got = features.pair_features(train_sym(spark, sf_dir), pairs, hops=1)
    return got.select("src", "trg", "com_ne", F.round("jacc_coeff", 6).alias("jacc_coeff"), F.round("res_alloc_ind", 6).alias("res_alloc_ind"), F.round("adam_adar", 6).alias("adam_adar"), "pref_attach", F.round("LHN", 6).alias("LHN"))


@query("svd_features")
def svd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = graph.symmetric(user_edges(spark, sf_dir))
    return features.approximate_svd_features(sym, user_edges(spark, sf_dir))


@query("impute_mean", "SELECT c_custkey, round(CASE WHEN c_custkey % 7 = 0 THEN (SELECT avg(c_acctbal) FROM customer WHERE c_custkey % 7 <> 0) ELSE c_acctbal END, 4) AS x FROM customer")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    return features.impute_mean(rows, ["x"]).withColumn("x", F.round("x", 4))


_FOLDS = "ntile(5) OVER (PARTITION BY y ORDER BY (src*73856093 + trg*19349663) % 1000003, src, trg)"


@query("stratified_folds", with_("target", f"SELECT src, trg, y, CAST({_FOLDS} AS INTEGER) AS fold FROM target WHERE sampler = 'uniform'"))
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = target(spark, sf_dir).where("sampler = 'uniform'").select("src", "trg", "y")
    return features.stratified_folds(rows, "y", F.struct(split.mixed(), "src", "trg"))


@query("oversample", """SELECT o_orderkey, o_orderstatus, unnest(range(1, CAST(floor(m / n) + CASE WHEN i < m % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy FROM (
  SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)) AS m FROM orders)""")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.oversample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", F.col("o_orderkey"))


@query("random_forest")
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = target(spark, sf_dir).where("sampler = 'uniform'").select("src", "trg", "y")
    names = ["com_ne", "jacc_coeff", "res_alloc_ind", "adam_adar", "pref_attach", "LHN"]
    rows = features.pair_features(train_sym(spark, sf_dir), pairs, hops=1).join(pairs, ["src", "trg"])
    rows = materialise(features.stratified_folds(rows, "y", F.struct(split.mixed(), "src", "trg")), "forest-rows")
    said, _shares = features.forest_held_out(rows.where("fold <> 1"), rows.where("fold = 1"), names, 6, 25)
    return said


# --- walks and embeddings --------------------------------------------------------------------------


def _user_walks(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    sym = graph.symmetric(user_edges(spark, sf_dir))
    starts = graph.global_rank(graph.degrees(sym).select(F.col("u").alias("node")), ["node"], "nth")
    return walks.walks(sym, walks.start_walks(starts, 2), 6, **options)


_WALK = """, num AS MATERIALIZED (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY u) AS k FROM usym),
starts AS MATERIALIZED (SELECT nth * 2 + j AS walk, u FROM (SELECT u, row_number() OVER (ORDER BY u) - 1 AS nth FROM (SELECT DISTINCT u FROM usym)), (VALUES (0), (1)) x(j)),
"""
_UNIFORM = _WALK + """walked(walk, step, cur, path) AS (SELECT walk, 0, u, [u] FROM starts UNION ALL
  SELECT w.walk, w.step + 1, n.v, list_append(w.path, n.v) FROM walked w JOIN num n ON n.u = w.cur AND n.i = ((w.walk * 48271 + (w.step + 2) * 16807) % 2147483647) * 69621 % 2147483647 % n.k WHERE w.step < 5)"""


@query("walk_uniform_hash", with_("usym", _UNIFORM + "\nSELECT walk, array_to_string(path, ' ') AS path FROM walked WHERE step = 5").replace("\n, num", ",\nnum"))
def walk_uniform_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_walks(spark, sf_dir).select("walk", F.array_join("path", " ").alias("path"))


@query("walk_nonbacktracking_hash", with_("usym", _WALK + """walked(walk, step, cur, prev, path) AS (SELECT walk, 0, u, CAST(NULL AS BIGINT), [u] FROM starts UNION ALL
  SELECT w.walk, w.step + 1, n.v, w.cur, list_append(w.path, n.v) FROM walked w JOIN num n ON n.u = w.cur LEFT JOIN num b ON b.u = w.cur AND b.v = w.prev
  WHERE w.step < 5 AND CASE WHEN w.prev IS NULL THEN n.i = ((w.walk * 48271 + (w.step + 2) * 16807) % 2147483647) * 69621 % 2147483647 % n.k
    ELSE n.k > 1 AND n.i = ((w.walk * 48271 + (w.step + 2) * 16807) % 2147483647) * 69621 % 2147483647 % greatest(n.k - 1, 1)
      + CASE WHEN ((w.walk * 48271 + (w.step + 2) * 16807) % 2147483647) * 69621 % 2147483647 % greatest(n.k - 1, 1) >= b.i THEN 1 ELSE 0 END END)
SELECT walk, array_to_string(path, ' ') AS path FROM walked q WHERE step = (SELECT max(step) FROM walked r WHERE r.walk = q.walk)""").replace("\n, num", ",\nnum"))
def walk_nonbacktracking_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_walks(spark, sf_dir, non_backtracking=True).select("walk", F.array_join("path", " ").alias("path"))


@query("walk_node2vec")
def walk_node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_walks(spark, sf_dir, p=0.5, q=2.0, restart=0.1).select("walk", F.array_join("path", " ").alias("path"))


@query("skipgram_pairs", with_("usym", _UNIFORM + """, pos AS (SELECT walk, unnest(path) AS x, generate_subscripts(path, 1) AS i FROM walked WHERE step = 5)
SELECT a.walk, a.x AS center, b.x AS context, count(*) AS n FROM pos a JOIN pos b ON b.walk = a.walk AND b.i <> a.i AND abs(b.i - a.i) <= 2 GROUP BY ALL""").replace("\n, num", ",\nnum"))
def skipgram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.skipgram_pairs(_user_walks(spark, sf_dir), 2).groupBy("walk", "center", "context").agg(F.count(F.lit(1)).alias("n"))


@query("stationary_30", with_("usym udeg", """, st(i, u, x) AS (SELECT 0, u, 1.0::DOUBLE / (SELECT count(*) FROM udeg) FROM udeg UNION ALL SELECT i + 1, s.v, sum(x / d.k) FROM st JOIN udeg d ON d.u = st.u JOIN usym s ON s.u = st.u WHERE i < 30 GROUP BY i, s.v)
SELECT u, round(sum(x) / 30, 6) AS pi FROM st WHERE i > 0 GROUP BY u""").replace("\n, st", ",\nst"))
def stationary_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.stationary(graph.symmetric(user_edges(spark, sf_dir)), 30).withColumn("pi", F.round("pi", 6))


@query("rwr_matrix", with_("usym udeg", """, rw(i, s, u, x) AS (SELECT 0, u, u, 1.0::DOUBLE FROM udeg UNION ALL SELECT i + 1, rw.s, t.v, sum(x / d.k) FROM rw JOIN udeg d ON d.u = rw.u JOIN usym t ON t.u = rw.u WHERE i < 3 GROUP BY i, rw.s, t.v)
SELECT s, u AS v, round(sum(0.15::DOUBLE * 0.85::DOUBLE ** (i - 1) * x), 6) AS w FROM rw WHERE i > 0 GROUP BY s, u""").replace("\n, rw", ",\nrw"))
def rwr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk from every node."""
    sym = graph.symmetric(user_edges(spark, sf_dir))
    seeds = graph.degrees(sym).select(F.col("u").alias("node"))
    return walks.random_walk_restart(sym, seeds, 0.15, 3).withColumn("w", F.round("w", 6))


@query("second_order_graph", with_("usym", """SELECT x.u AS a, x.v AS b, y.v AS c, CASE WHEN x.u = y.v THEN 2.0::DOUBLE WHEN EXISTS (SELECT 1 FROM usym t WHERE t.u = x.u AND t.v = y.v) THEN 1.0 ELSE 0.5 END AS w
FROM usym x JOIN usym y ON y.u = x.v"""))
def second_order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.second_order_graph(graph.symmetric(user_edges(spark, sf_dir)), 0.5, 2.0)


def _embedding_query(name: str, get=user_edges, **options) -> None:
    @query(f"embed_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return embedding.EMBEDDINGS[name](graph.symmetric(get(spark, sf_dir)), 8, **options)


for _name, _opts in {"degree": {}, "fastrp": {}, "node2vec": {"num_walks": 2, "walk_length": 8}, "line": {"num_walks": 2, "walk_length": 8}, "nonbacktracking_walk": {"num_walks": 2, "walk_length": 8}, "leigenmap": {}, "adjspec": {}, "modspec": {}, "highorder_modularity": {}, "linearized_node2vec": {}, "nonbacktracking": {}, "netmf": {}, "spectral_transformation": {}, "dcsbm": {}}.items():
    _embedding_query(_name, **_opts)


@query("message_pass", with_("usym udeg", "SELECT s.u AS id, CAST(max(d.k) AS DOUBLE) AS most, round(avg(d.k), 6) AS mean FROM usym s JOIN udeg d ON d.u = s.v GROUP BY s.u"))
def message_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = graph.symmetric(user_edges(spark, sf_dir))
    emb = embedding.degree_embedding(sym, 2)
    one = lambda how, name: embedding.message_pass(sym, emb, 2, how).select("id", F.round(F.get("vec", F.lit(0)), 6).alias(name))
    return one("max", "most").join(one("mean", "mean"), "id")


@query("kmeans")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.kmeans(_vectors(spark, sf_dir).select("id", "vec"), 10)


@query("partition_model")
def partition_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.partition_model(spark, 1000, 5, 10.0, 0.3)[0]


@query("price_model")
def price_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.price_model(spark, 3, 2.0, 1000)


@query("lfr_model")
def lfr_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.lfr_model(spark, 1000, 10.0, 0.2)[0]


@query("streaming_degrees", with_("deg", "SELECT u, k FROM deg"))
def streaming_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table as a stream; after all of it the degrees are those of the batch."""
    from edgeloom.sources.io import write_table
    from edgeloom.streaming.degrees import edge_stream, streaming_degrees

    folder = f"{scratch_root(spark)}/stream-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    write_table(edges(spark, sf_dir), folder)
    kept: list[DataFrame] = []
    flow = streaming_degrees(edge_stream(spark, folder)).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}-state-{len(base._MADE)}")
    run = flow.foreachBatch(lambda df, _: kept.append(materialise(df, "stream-degrees"))).trigger(availableNow=True).start()
    run.awaitTermination()
    return kept[-1]
