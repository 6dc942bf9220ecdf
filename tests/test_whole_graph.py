"""Registered queries over every node of a small graph, against brute force."""

import pytest

from edgeloom.operators import graph
from edgeloom.operators.dataset import as_edges
from edgeloom.plans import base, graph_queries
from tests.test_graph import TIES

#: Three more in a row hang on the club, and two are apart from it.
TAIL = [(33, 41), (41, 42), (42, 43), (50, 51)]
ALL = TIES + TAIL
NEAR: dict[int, set[int]] = {}
for _a, _b in ALL:
    NEAR.setdefault(_a, set()).add(_b)
    NEAR.setdefault(_b, set()).add(_a)


@pytest.fixture
def run(spark, monkeypatch):
    e = as_edges(spark, ALL)
    sym = graph.symmetric(e)
    for name, df in (("user_edges", e), ("train_sym", sym), ("train_degrees", graph.degrees(sym))):
        monkeypatch.setattr(graph_queries, name, lambda s, d, df=df: df)
    return lambda name: base.QUERIES[name](spark, "none").collect()


def test_ranking_of_every_node(run):
    want = set()
    for u in NEAR:
        shared = sorted((-len(NEAR[u] & NEAR[v]), v) for v in NEAR if v != u and v not in NEAR[u] and NEAR[u] & NEAR[v])
        want |= {(u, v, i + 1) for i, (_, v) in enumerate(shared[:10])}
    assert {(r["u"], r["v"], r["rank"]) for r in run("ranking_candidates")} == want


def test_walks_from_every_node(run):
    rwr, ppr = {}, {}
    for s in NEAR:
        x, y = {s: 1.0}, {s: 1.0}
        for i in range(10):
            nx, ny = {}, {s: 0.15}
            for u in NEAR:
                for v in NEAR[u]:
                    if u in x:
                        nx[v] = nx.get(v, 0) + x[u] / len(NEAR[u])
                    if u in y:
                        ny[v] = ny.get(v, 0) + 0.85 * y[u] / len(NEAR[u])
            x, y = nx, ny
            if i < 3:
                for v, w in x.items():
                    rwr[s, v] = rwr.get((s, v), 0) + 0.15 * 0.85**i * w
        ppr |= {(s, u): w for u, w in y.items()}
    assert {(r["s"], r["v"]): r["w"] for r in run("rwr_matrix")} == pytest.approx(rwr, abs=1e-6)
    assert {(r["s"], r["u"]): r["ppr"] for r in run("personalised_pagerank")} == pytest.approx(ppr, abs=1e-9)


def test_second_order_of_every_edge(run):
    want = {(a, b, c): 2.0 if a == c else 1.0 if c in NEAR[a] else 0.5 for a in NEAR for b in NEAR[a] for c in NEAR[b]}
    assert {(r["a"], r["b"], r["c"]): r["w"] for r in run("second_order_graph")} == want


def test_negatives_are_padded_on_the_whole_graph(run):
    got = run("negatives_with_duplicates")
    free = {(a, b) for a in NEAR for b in NEAR if a < b and b not in NEAR[a]}
    assert len(got) == len(NEAR) * (len(NEAR) - 1) // 2
    assert {(r["src"], r["trg"]) for r in got} == free


def levels(s):
    """Hops from ``s`` to all that it reaches."""
    seen, front = {s: 0}, [s]
    while front:
        front = [v for u in front for v in NEAR[u] if seen.setdefault(v, seen[u] + 1) == seen[u] + 1 and v not in (s, *front)]
        front = list(dict.fromkeys(front))
    return seen


def test_paths_of_any_length(run, spark, monkeypatch):
    pairs = [(16, 43), (43, 0), (0, 51), (50, 51), (12, 42), (16, 41), (7, 7), (7, 99)]
    monkeypatch.setattr(graph_queries, "test_edges", lambda s, d: spark.createDataFrame(pairs, "src long, trg long"))
    got = {(r["src"], r["trg"]): r["hops"] for r in run("short_path")}
    assert got == {(a, b): levels(a).get(b) for a, b in pairs} and max(x or 0 for x in got.values()) > 4
    bounded = graph.hop_distances(graph.symmetric(as_edges(spark, ALL)), spark.createDataFrame(pairs, "src long, trg long"), 3)
    assert {(r["src"], r["trg"]): r["hops"] for r in bounded.collect()} == {k: v if v is not None and v <= 3 else None for k, v in got.items()}


def test_closeness_of_every_node(run):
    want = {}
    for s in NEAR:
        d = levels(s)
        want[s] = (len(d) - 1) ** 2 / sum(d.values()) / (len(NEAR) - 1)
    assert max(max(levels(s).values()) for s in NEAR) > 6
    assert {r["node"]: r["cc"] for r in run("closeness")} == pytest.approx(want, abs=1e-6)
