"""Tasks that hold the graph, against the joins that larger graphs take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import around, features, graph, scorers, walks
from edgeloom.operators.dataset import as_edges
from edgeloom.plans import base, graph_queries, result_queries  # noqa: F401
from tests.test_graph import TIES

#: Beside the club: a tail, a pair apart and a node with a large id.
ALL = [*TIES, (33, 41), (41, 42), (42, 43), (50, 51), (43, 1 << 40)]


@pytest.fixture(scope="module")
def sym(spark):
    return graph.materialise(graph.symmetric(as_edges(spark, ALL)), "club")


@pytest.fixture
def joined(monkeypatch):
    """Nothing is held from here on."""

    def off():
        monkeypatch.setattr(around, "held", lambda *_: None)

    return off


def table(df, *keys):
    return {tuple(r[k] for k in keys): tuple(v for c, v in r.asDict().items() if c not in keys) for r in df.collect()}


def test_scores_of_pairs(spark, sym, joined, monkeypatch):
    monkeypatch.setattr(around, "BLOCK", 7)
    nodes = sym.select("u").distinct().union(spark.range(1).selectExpr("77L as u"))
    pairs = nodes.select(F.col("u").alias("src")).crossJoin(nodes.select(F.col("u").alias("trg"))).where("src < trg")
    names = list(scorers.SCORERS)
    got = table(scorers.score_models(names, sym, pairs), "src", "trg")
    joined()
    want = table(scorers.score_models(names, sym, pairs), "src", "trg")
    assert got.keys() == want.keys() and len(got) == len(pairs.collect())
    for key, x in got.items():
        assert x == pytest.approx(want[key], abs=1e-12)


def test_scores_shuffle_nothing(spark, sym):
    pairs = spark.createDataFrame([(1, 2)], "src long, trg long")
    plan = scorers.score_models(list(scorers.SCORERS), sym, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["localRandomWalk", "localPathIndex"])
@pytest.mark.parametrize("alone", [False, True])
def test_top_paths(sym, joined, monkeypatch, name, alone):
    deg = graph.degrees(sym)
    top = scorers.top_k(name, sym, deg, 5, alone)
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    got = table(top, "u", "rank")
    joined()
    want = table(scorers.top_k(name, sym, deg, 5, alone), "u", "rank")
    assert got.keys() == want.keys()
    for key, (v, score) in got.items():
        assert v == want[key][0] and score == pytest.approx(want[key][1], abs=1e-12)


@pytest.mark.parametrize("query", ["dense_rank_models", "pivot_ranks", "rank_change", "rank_models", "auc_by_model_sampler"])
def test_models_are_scored_without_joins(spark, sym, joined, monkeypatch, query):
    rows = [(s, a, b, y) for s in ("uniform", "degreeBiased") for y, pairs in ((1, TIES[:20]), (0, [(a, b) for a, b in zip(range(1, 20), range(15, 34)) if (a, b) not in TIES][: 12 if s == "uniform" else 17])) for a, b in pairs]
    target = spark.createDataFrame(rows, "sampler string, src long, trg long, y int")
    monkeypatch.setattr(graph_queries, "target", lambda *_: target)
    monkeypatch.setattr(graph_queries, "train_sym", lambda *_: sym)
    run = lambda: sorted(map(tuple, base.QUERIES[query](spark, "none").collect()))
    with monkeypatch.context() as m:
        m.setattr(scorers, "score_pairs", None)
        got = run()
    joined()
    assert got == run()


@pytest.mark.parametrize("query, scorer", [("topk_lpi", "neighbour_sums"), ("topk_lrw", "neighbour_sums")])
def test_top_paths_of_queries(sym, monkeypatch, query, scorer):
    monkeypatch.setattr(graph_queries, "train_sym", lambda *_: sym)
    monkeypatch.setattr(graph_queries, "train_degrees", lambda *_: graph.degrees(sym))
    monkeypatch.setattr(scorers, scorer, None)
    assert {r["u"] for r in base.QUERIES[query](sym.sparkSession, "none").collect()} == {x for e in ALL for x in e}


def without_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Join" not in plan and "BatchScan" not in plan


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_restarting_walks(spark, sym, joined, monkeypatch, block):
    monkeypatch.setattr(around, "BLOCK", block)
    seeds = sym.select(F.col("u").alias("node")).distinct().union(spark.range(1).selectExpr("77L as node"))
    df = walks.random_walk_restart(sym, seeds, 0.15, 3)
    assert without_joins(df)
    got = table(df, "s", "v")
    joined()
    want = table(walks.random_walk_restart(sym, seeds, 0.15, 3), "s", "v")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_personal_ranks(spark, sym, joined, monkeypatch, block):
    monkeypatch.setattr(around, "BLOCK", block)
    seeds = sym.select(F.col("u").alias("node")).distinct().union(spark.range(1).selectExpr("77L as node"))
    df = features.personalised_pagerank(sym, seeds, 5)
    assert without_joins(df)
    got = table(df, "s", "u")
    joined()
    want = table(features.personalised_pagerank(sym, seeds, 5), "s", "u")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("most", [None, 2])
def test_closeness(sym, joined, most):
    sources = sym.select(F.col("u").alias("node")).distinct()
    got = table(features.closeness(sym, sources, most), "node")
    joined()
    want = table(features.closeness(sym, sources, most), "node")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("most", [None, 3])
@pytest.mark.parametrize("block", [10, 2_000_000])
def test_distances(spark, sym, joined, monkeypatch, most, block):
    monkeypatch.setattr(around, "BLOCK", block)
    nodes = sym.select("u").distinct().union(spark.range(1).selectExpr("77L as u"))
    pairs = nodes.select(F.col("u").alias("src")).crossJoin(nodes.select(F.col("u").alias("trg")))
    df = graph.hop_distances(sym, pairs, most)
    assert "hop-left" not in df._jdf.queryExecution().executedPlan().toString()
    got = table(df, "src", "trg")
    joined()
    assert got == table(graph.hop_distances(sym, pairs, most), "src", "trg")


@pytest.mark.parametrize("load", [False, True])
def test_betweenness_of_blocks(sym, monkeypatch, load):
    """Against shares of paths from distances and numbers of paths; blocks of one source and of all."""
    near = {}
    for a, b in ALL:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        level, count, order = {s: 0}, {s: 1.0}, [s]
        for x in order:
            for y in near[x]:
                if y not in level:
                    level[y], count[y] = level[x] + 1, 0.0
                    order.append(y)
                if level[y] == level[x] + 1:
                    count[y] += count[x]
        flow = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            up = [x for x in near[y] if level[x] == level[y] - 1]
            for x in up:
                flow[x] += (1 + flow[y]) * (1 / len(up) if load else count[x] / count[y])
            total[y] += flow[y] if y != s else 0
    n = len(near)
    for block in (1, 2_000_000):
        monkeypatch.setattr(around, "BLOCK", block)
        got = {r["u"]: r["bc"] for r in features.betweenness(sym, load=load).collect()}
        assert got == pytest.approx({u: x / ((n - 1) * (n - 2)) for u, x in total.items()})


def test_slots_and_hubs(sym):
    g = around.held(sym).value
    x = np.arange(3.0 * len(g.ids)).reshape(-1, 3)
    for most in (0, 1, 4, 256):
        assert around.Slots(g, most).around(x) == pytest.approx(g.around(x))


def test_what_is_sent_is_small_and_whole():
    import pickle

    rng = np.random.default_rng(5)
    u = np.repeat(np.arange(20_000), 8)
    v = (u + rng.integers(1, 200, len(u))) % 20_000
    g = around.Graph(np.concatenate([u, v, [7, 1 << 40]]), np.concatenate([v, u, [1 << 40, 7]]))
    sent = pickle.dumps(g)
    assert len(sent) < 2 * len(g.near)  # a neighbour's number alone has 4 bytes
    got = pickle.loads(sent)
    empty = pickle.loads(pickle.dumps(around.Graph(u[:0], u[:0])))
    for x in ("ids", "at", "near", "k"):
        assert getattr(got, x).dtype == getattr(g, x).dtype and (getattr(got, x) == getattr(g, x)).all()
    assert not len(empty.ids) and not len(empty.near)


@pytest.mark.parametrize("load", [False, True])
def test_betweenness_block_by_block(spark, monkeypatch, load):
    """Parts that hang together by single nodes and edges are searched alone, with the same result."""
    from edgeloom.operators import blocks

    rng = np.random.default_rng(7)
    edges = {(n * 10 + int(a), n * 10 + int(b)) for n in range(4) for a, b in rng.integers(0, 10, (18, 2)) if a < b}
    edges |= {(3, 13), (15, 25), (25, 31), (25, 77), (77, 78), (90, 91)}
    u, v = np.array(sorted(edges)).T
    g = around.Graph(np.concatenate([u, v]), np.concatenate([v, u]))
    whole, searched = around.flows(g, np.arange(len(g.ids)), load), []
    monkeypatch.setattr(blocks, "part", lambda g, members, make=blocks.part: searched.append(len(members)) or make(g, members))
    got = blocks.Blocks(g)
    total = got.crossing.copy()
    for at, to in zip(got.at[:-1], got.at[1:]):
        own = blocks.part(g, got.members[at:to])
        total[own.ids] += around.flows(own, np.arange(len(own.ids)), load, got.weight[at:to])
    assert max(searched) <= 11 and total == pytest.approx(whole, abs=1e-9)
    sym = graph.symmetric(as_edges(spark, sorted(edges)))
    n = len(g.ids)
    rows = {r["u"]: r["bc"] for r in features.betweenness(sym, load=load).collect()}
    assert rows == pytest.approx(dict(zip(g.ids.tolist(), whole / ((n - 1) * (n - 2)))), abs=1e-12)


def test_walks_hold_what_they_reach(spark, monkeypatch):
    """On a long path, seeds' walks are made on the nodes within their steps, and nothing else makes rows."""
    from edgeloom.operators import blocks

    held = []
    sym = graph.symmetric(as_edges(spark, [(i, i + 1) for i in range(400)]))
    shared = around.held(sym)
    monkeypatch.setattr(blocks, "part", lambda g, ball, make=blocks.part: held.append(len(ball)) or make(g, ball))

    class Seeds:
        sparkSession = spark

        def select(self, *_):
            return self

        def repartitionByRange(self, *_):
            return self

        def mapInArrow(self, run, _schema):
            ids = walks.pa.array([100, 102, 900], walks.pa.int64())
            return [tuple(r.values()) for b in run([walks.pa.RecordBatch.from_arrays([ids], ["node"])]) for r in b.to_pylist()]

    got = walks.ball_rows(shared, Seeds(), 3, 0.15, 0.85, "s long, u long, ppr double")
    assert held == [9] and {r[:2] for r in got} == {(900, 900), *((s, u) for s in (100, 102) for u in range(s - 3, s + 4))}
    assert sum(r[2] for r in got if r[0] == 100) == pytest.approx(1.0)
