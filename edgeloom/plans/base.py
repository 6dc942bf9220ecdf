"""Graphs derived from the relational tables, the benchmark recipe, and the SQL pieces that mirror them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.operators.graph import canonical_edges, degrees, symmetric
from edgeloom.operators.sampling import ends, negatives, stubs
from edgeloom.operators.split import test_of
from edgeloom.storage import settled, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_MADE: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL if it has one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(tag: str):
    """A table that several queries of one application share is made and written once; what it was made from goes."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, tag)
            if key not in _MADE:
                _MADE[key] = settled(lambda: f(spark, sf_dir), tag, keep=True)
            return _MADE[key]

        return get

    return wrap


def seen(f: Callable[[SparkSession, str], DataFrame]):
    """Rows of shared tables that several queries read from there: no files of their own."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f.__name__)
        if key not in _MADE:
            _MADE[key] = view(f(spark, sf_dir))
        return _MADE[key]

    return get


def _copurchase(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where(condition).select("l_orderkey", "l_partkey")
    # Both sides are the same rows under the same names: Spark shuffles them once.
    both = items.alias("a").join(items.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey"))
    return canonical_edges(both.select(F.col("a.l_partkey").alias("one"), F.col("b.l_partkey").alias("other")))


@once("edges")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were returned from one order."""
    return _copurchase(spark, sf_dir, "l_returnflag = 'R'")


@once("sparse-edges")
def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copurchase(spark, sf_dir, "l_quantity >= 40")


@once("user-edges")
def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different users of consecutive purchases."""
    # Days first: a global order would be one task; consecutive events across days are added back.
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    inside = e.select(F.lag("user_id").over(w).alias("a"), F.col("user_id").alias("b")).where("a is not null")
    ends = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = ends.select(F.lag("last").over(Window.orderBy("day")).alias("a"), F.col("first").alias("b")).where("a is not null")
    return canonical_edges(inside.union(across).where("a <> b"))


@once("test")
def test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_of(edges(spark, sf_dir), 0.25)


@once("train")
def train_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).join(test_edges(spark, sf_dir), ["src", "trg"], "left_anti")


@seen
def train_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetric(train_edges(spark, sf_dir))


@once("train-degrees")
def train_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(train_sym(spark, sf_dir))


def negative_edges(spark: SparkSession, sf_dir: str, biased: bool, seed: int = 0) -> DataFrame:
    sym = train_sym(spark, sf_dir)
    population = ends(sym, biased) or settled(lambda: stubs(sym, biased), "stubs")
    return negatives(population, edges(spark, sf_dir), test_edges(spark, sf_dir).count(), seed)


@once("negatives-uniform")
def uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_edges(spark, sf_dir, False)


@once("negatives-biased")
def biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_edges(spark, sf_dir, True)


@seen
def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sampler, src, trg, y): held-out edges and both samplers' negatives."""
    pos = test_edges(spark, sf_dir).select("src", "trg", F.lit(1).alias("y"))
    out = None
    for name, neg in (("uniform", uniform), ("degreeBiased", biased)):
        part = pos.union(neg(spark, sf_dir).select("src", "trg", F.lit(0).alias("y"))).select(F.lit(name).alias("sampler"), "src", "trg", "y")
        out = part if out is None else out.union(part)
    return out


# --- the same in SQL -------------------------------------------------------------------------------

_PAIRS = """SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS trg
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE {c}"""

_NEG = """SELECT src, trg, draw FROM (
  SELECT src, trg, min(d) AS draw, row_number() OVER (ORDER BY min(d)) AS r FROM (
    SELECT least(x.node, y.node) AS src, greatest(x.node, y.node) AS trg, d FROM (
      SELECT d, ((d*2+1+{s})*48271 % 2147483647) * 16807 % 2147483647 % (SELECT count(*) FROM {p}) AS a,
             ((d*2+2+{s})*69621 % 2147483647) * 39373 % 2147483647 % (SELECT count(*) FROM {p}) AS b
      FROM (SELECT unnest(range(3 * (SELECT count(*) FROM test))) AS d)) q
    JOIN {p} x ON x.i = q.a JOIN {p} y ON y.i = q.b WHERE x.node <> y.node) z
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = z.src AND e.trg = z.trg) GROUP BY src, trg)
  WHERE r <= (SELECT count(*) FROM test)"""

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "edges": ((), _PAIRS.format(c="a.l_returnflag = 'R' AND b.l_returnflag = 'R'")),
    "sparse": ((), _PAIRS.format(c="a.l_quantity >= 40 AND b.l_quantity >= 40")),
    "users": ((), """SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS trg FROM (
  SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS a, user_id AS b FROM events WHERE event_type = 'purchase') WHERE a <> b"""),
    "sym": (("edges",), "SELECT src AS u, trg AS v FROM edges UNION ALL SELECT trg, src FROM edges"),
    "usym": (("users",), "SELECT src AS u, trg AS v FROM users UNION ALL SELECT trg, src FROM users"),
    "ssym": (("sparse",), "SELECT src AS u, trg AS v FROM sparse UNION ALL SELECT trg, src FROM sparse"),
    "deg": (("sym",), "SELECT u, count(*) AS k FROM sym GROUP BY u"),
    "udeg": (("usym",), "SELECT u, count(*) AS k FROM usym GROUP BY u"),
    "bfs(node, level)": (("sym",), "SELECT min(u), 0 FROM sym UNION SELECT s.v, b.level + 1 FROM bfs b JOIN sym s ON s.u = b.node WHERE b.level < 9"),
    "lvl": (("bfs(node, level)",), "SELECT node, min(level) AS level FROM bfs GROUP BY node"),
    "tree": (("lvl", "sym"), """SELECT least(node, p) AS src, greatest(node, p) AS trg FROM (
  SELECT l.node, min(s.v) AS p FROM lvl l JOIN sym s ON s.u = l.node JOIN lvl q ON q.node = s.v AND q.level = l.level - 1 GROUP BY l.node)"""),
    "test": (("edges", "tree"), """SELECT src, trg FROM (
  SELECT src, trg, row_number() OVER (ORDER BY (src*73856093 + trg*19349663) % 1000003, src, trg) AS r
  FROM edges e WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.src = e.src AND t.trg = e.trg))
  WHERE r <= (SELECT floor(0.25 * count(*)) FROM edges)"""),
    "train": (("edges", "test"), "SELECT src, trg FROM edges e WHERE NOT EXISTS (SELECT 1 FROM test t WHERE t.src = e.src AND t.trg = e.trg)"),
    "tsym": (("train",), "SELECT src AS u, trg AS v FROM train UNION ALL SELECT trg, src FROM train"),
    "tdeg": (("tsym",), "SELECT u, count(*) AS k FROM tsym GROUP BY u"),
    "stub_b": (("tsym",), "SELECT row_number() OVER (ORDER BY u, v) - 1 AS i, u AS node FROM tsym"),
    "stub_u": (("tdeg",), "SELECT row_number() OVER (ORDER BY u) - 1 AS i, u AS node FROM tdeg"),
    "neg_u": (("test", "stub_u", "edges"), _NEG.format(p="stub_u", s=0)),
    "neg_b": (("test", "stub_b", "edges"), _NEG.format(p="stub_b", s=0)),
    "neg_u2": (("test", "stub_u", "edges"), _NEG.format(p="stub_u", s=2000)),
    "target": (("test", "neg_u", "neg_b"), """SELECT 'uniform' AS sampler, src, trg, CAST(1 AS INTEGER) AS y FROM test UNION ALL SELECT 'uniform', src, trg, 0 FROM neg_u
  UNION ALL SELECT 'degreeBiased', src, trg, 1 FROM test UNION ALL SELECT 'degreeBiased', src, trg, 0 FROM neg_b"""),
    "pairs": (("target",), "SELECT DISTINCT src, trg FROM target"),
    "ends": (("pairs", "tdeg"), "SELECT p.src, p.trg, a.k AS ki, b.k AS kj FROM pairs p JOIN tdeg a ON a.u = p.src JOIN tdeg b ON b.u = p.trg"),
    "near": (("ends", "tsym", "tdeg"), """SELECT e.src, e.trg, count(z.k) AS cn, coalesce(sum(1.0::DOUBLE / z.k), 0) AS ra,
  coalesce(sum(CASE WHEN z.k IS NOT NULL THEN 1.0::DOUBLE / greatest(ln(z.k), 1.0) END), 0) AS aa, coalesce(sum(CASE WHEN z.k > 1 THEN 1.0::DOUBLE / ln(z.k) END), 0) AS aat
  FROM ends e LEFT JOIN (SELECT s.u AS a, t.u AS b, d.k FROM tsym s JOIN tsym t ON t.v = s.v JOIN tdeg d ON d.u = s.v) z ON z.a = e.src AND z.b = e.trg GROUP BY e.src, e.trg"""),
    "far": (("ends", "tsym", "tdeg"), """SELECT e.src, e.trg, count(q.z) AS n3, coalesce(sum(1.0::DOUBLE / (q.kz * q.kw)), 0) AS w3 FROM ends e LEFT JOIN (
  SELECT p.src, p.trg, a.v AS z, dz.k AS kz, dw.k AS kw FROM pairs p JOIN tsym a ON a.u = p.src JOIN tsym m ON m.u = a.v JOIN tsym b ON b.u = m.v AND b.v = p.trg
  JOIN tdeg dz ON dz.u = a.v JOIN tdeg dw ON dw.u = m.v) q ON q.src = e.src AND q.trg = e.trg GROUP BY e.src, e.trg"""),
    "scored": (("ends", "near", "far", "tdeg", "tsym"), """SELECT e.src, e.trg, m.model, m.score FROM ends e JOIN near n ON n.src = e.src AND n.trg = e.trg JOIN far f ON f.src = e.src AND f.trg = e.trg,
  LATERAL (VALUES ('preferentialAttachment', CAST(e.ki * e.kj AS DOUBLE)), ('logPreferentialAttachment', ln(e.ki) + ln(e.kj)), ('commonNeighbors', CAST(n.cn AS DOUBLE)),
  ('jaccardIndex', n.cn / CAST(greatest(e.ki + e.kj - n.cn, 1) AS DOUBLE)), ('resourceAllocation', n.ra), ('adamicAdar', n.aa), ('adamicAdarTextbook', n.aat),
  ('leichtHolmeNewman', n.cn / CAST(e.ki * e.kj AS DOUBLE)),
  ('localRandomWalk', ((SELECT count(*) FROM tsym x WHERE x.u = e.src AND x.v = e.trg) + n.ra + f.w3) / (SELECT CAST(sum(k) AS DOUBLE) FROM tdeg)),
  ('localPathIndex', n.cn + 0.001::DOUBLE * f.n3)) AS m(model, score)"""),
    "results": (("target", "scored"), """SELECT model, sampler, sum(p * (below + 0.5::DOUBLE * n)) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY model, sampler ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT s.model, t.sampler, round(s.score, 9) AS score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
    FROM target t JOIN scored s ON s.src = t.src AND s.trg = t.trg GROUP BY ALL)) GROUP BY model, sampler"""),
    "stats_edges": (("edges", "sparse", "users"), "SELECT 'copurchase' AS network, src, trg FROM edges UNION ALL SELECT 'sparse', src, trg FROM sparse UNION ALL SELECT 'users', src, trg FROM users"),
    "stats_sym": (("stats_edges",), "SELECT network, src AS u, trg AS v FROM stats_edges UNION ALL SELECT network, trg, src FROM stats_edges"),
    "stats_deg": (("stats_sym",), "SELECT network, u, count(*) AS k FROM stats_sym GROUP BY network, u"),
    "wedge": (("tsym",), "SELECT a.u, b.v, a.v AS z FROM tsym a JOIN tsym b ON b.u = a.v"),
    "groups": ((), "SELECT CAST(vec_id AS BIGINT) AS id, label AS a, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS b FROM embeddings"),
}


def with_(names: str, body: str) -> str:
    """``body`` after the named pieces and all they need."""
    order: list[str] = []

    def need(n: str) -> None:
        full = next(k for k in _CTES if k.split("(")[0] == n.split("(")[0])
        if full not in order:
            for d in _CTES[full][0]:
                need(d)
            order.append(full)

    for n in names.split():
        need(n)
    parts = [f"{n} AS {'' if n.startswith('bfs(') else 'MATERIALIZED '}({_CTES[n][1]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
