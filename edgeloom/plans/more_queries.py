"""Queries over single operators: ranking by embedding, samplers, matrix powers, repairs, scans, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import embedding, evaluation, features, graph, ranking, sampling, walks
from edgeloom.plans.base import edges, query, table, user_edges, with_
from edgeloom.plans.graph_queries import _KNN, _UNIFORM, _user_walks, _vectors, results, scored
from edgeloom.sources import io
from edgeloom.storage import materialise, scratch_root

_USER_DEGREE = "greatest(coalesce((SELECT k FROM udeg WHERE udeg.u = b.vec_id), 1), 1)"


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sym = graph.symmetric(user_edges(spark, sf_dir))
    return sym, graph.degrees(sym)


@query("knn_log_degree", with_("udeg", _KNN.format(bonus=f"ln({_USER_DEGREE})")))
def knn_log_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best inner products after the log of the key's degree is added."""
    e = _vectors(spark, sf_dir).select("id", "vec")
    return ranking.knn_inner_product(ranking.log_degree_bonus(e, _users(spark, sf_dir)[1]), e, 10, "bonus").select("u", "v", "rank")


_RANKED = """SELECT u, v, r AS rank FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) AS r FROM (
  SELECT a.vec_id AS u, b.vec_id AS v, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + {bonus}, 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE NOT EXISTS (SELECT 1 FROM usym x WHERE x.u = a.vec_id AND x.v = b.vec_id))) WHERE r <= 10"""


@query("rank_by_embedding", with_("usym udeg", _RANKED.format(bonus="0")))
def rank_by_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_by_embedding(_vectors(spark, sf_dir).select("id", "vec"), *_users(spark, sf_dir), 10).select("u", "v", "rank")


@query("rank_by_embedding_degree", with_("usym udeg", _RANKED.format(bonus=f"ln({_USER_DEGREE} / (SELECT CAST(sum(k) AS DOUBLE) FROM udeg))")))
def rank_by_embedding_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).select("id", "vec")
    return ranking.rank_by_embedding(e, *_users(spark, sf_dir), 10, degree_corrected=True).select("u", "v", "rank")


@query("log_degree_corrected", with_("udeg", """SELECT a.vec_id AS src, b.vec_id AS trg, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + ln(greatest(coalesce(x.k, 0), 1)) + ln(greatest(coalesce(y.k, 0), 1)), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 LEFT JOIN udeg x ON x.u = a.vec_id LEFT JOIN udeg y ON y.u = b.vec_id"""))
def log_degree_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).select("id", "vec")
    scores = embedding.score_by_dot(e, e.select(F.col("id").alias("src"), (F.col("id") + 1).alias("trg")))
    return embedding.log_degree_corrected(scores, _users(spark, sf_dir)[1]).withColumn("score", F.round("score", 6))


@query("power_sum", with_("usym udeg", """, e AS (SELECT s.u, s.v, 1.0::DOUBLE / d.k AS w FROM usym s JOIN udeg d ON d.u = s.u),
two AS (SELECT a.u, b.v, sum(a.w * b.w) AS w FROM e a JOIN e b ON b.u = a.v GROUP BY a.u, b.v)
SELECT u, v, round(sum(w), 6) AS w FROM (SELECT * FROM e UNION ALL SELECT * FROM two) GROUP BY u, v""").replace("\n, e", ",\ne"))
def power_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym, deg = _users(spark, sf_dir)
    step = sym.join(deg, "u").select("u", "v", (F.lit(1.0) / F.col("k")).alias("w"))
    return walks.power_sum(step, 2).withColumn("w", F.round("w", 6))


@query("walk_context", with_("usym", _UNIFORM + """
SELECT walk, path[1] AS src, path[2 + ((walk * 48271 + 8 * 16807) % 2147483647) * 69621 % 2147483647 % (len(path) - 1)] AS trg FROM walked WHERE step = 5""").replace("\n, num", ",\nnum"))
def walk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each walk's start with one of its later nodes."""
    return walks.context_node(_user_walks(spark, sf_dir))


@query("sample_with_replacement", """SELECT d AS draw, c_custkey FROM (SELECT unnest(range(500)) AS d) q JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer) c
ON c.i = ((d * 2 + 1 + 6) * 48271 % 2147483647) * 16807 % 2147483647 % (SELECT count(*) FROM customer)""")
def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_with_replacement(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 500, 3)


@query("recode_sentinels", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 1000 * (SELECT max(c_nationkey) FROM customer WHERE c_custkey % 5 <> 0) ELSE c_nationkey END AS short_path,
CASE WHEN c_custkey % 3 = 0 THEN 1e6::DOUBLE ELSE CAST(c_nationkey AS DOUBLE) END AS diam_net FROM customer""")
def recode_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing distances (every fifth row) and diameters (every third) as their sentinels."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(c % 5 != 0, n.cast("long")).alias("short_path"), F.when(c % 3 != 0, n.cast("double")).alias("diam_net"))
    return features.recode_sentinels(rows, diameter="diam_net")


@query("global_top", with_("target scored", """SELECT t.src, t.trg, round(s.score, 9) AS score FROM target t JOIN scored s ON s.src = t.src AND s.trg = t.trg
WHERE t.sampler = 'uniform' AND s.model = 'resourceAllocation' ORDER BY 3 DESC, 1, 2 LIMIT 100"""))
def global_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, "resourceAllocation").where("sampler = 'uniform'")
    return ranking.global_top(rows.select("src", "trg", F.round("score", 9).alias("score")), 100)


@query("lda_separation", with_("results", "SELECT model, sampler, round(greatest(auc, 1 - auc), 9) AS separation FROM results"))
def lda_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    return rows.select("model", "sampler", F.round(evaluation.lda_separation(rows), 9).alias("separation"))


@query("calibrated_scores")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform target's scores through a logistic regression that the degree-biased target fits."""
    rows = materialise(scored(spark, sf_dir, "logPreferentialAttachment"), "calibration")
    return features.calibrated(rows.where("sampler = 'degreeBiased'").select("y", "score"), rows.where("sampler = 'uniform'").select("src", "trg", "y", "score"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("edge_csv_scan", with_("edges", "SELECT src, trg FROM edges"))
def edge_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges after a CSV sink and a CSV scan."""
    path = _folder(spark, "edge-csv")
    io.write_table(edges(spark, sf_dir), path, "csv")
    return io.read_edge_csv(spark, path)


@query("table_scan_orc", with_("edges", "SELECT src, trg FROM edges"))
def table_scan_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges after a sink and a scan by their fixed schema in another format."""
    from edgeloom import schema

    path = _folder(spark, "edge-orc")
    io.write_table(edges(spark, sf_dir), path, "orc")
    return io.read_table(spark, path, schema.EDGES, "orc")


@query("windowed_edge_counts", "SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M') AS began, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def windowed_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases a window of event time, from a stream that is read to its end."""
    from edgeloom.streaming.degrees import windowed_edge_counts as counts

    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("ts"))
    path = _folder(spark, "event-stream")
    io.write_table(rows, path)
    kept: list[DataFrame] = []
    flow = counts(spark.readStream.schema(rows.schema).parquet(path)).writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state")
    flow.foreachBatch(lambda df, _: kept.append(materialise(df, "stream-windows"))).trigger(availableNow=True).start().awaitTermination()
    return kept[-1].select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("began"), "n")
