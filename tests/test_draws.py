"""Negatives drawn in tasks, against those that are joined."""

import pytest

from edgeloom.operators import draws, graph, sampling
from edgeloom.operators.dataset import as_edges
from edgeloom.storage import materialise
from tests.test_graph import TIES


@pytest.mark.parametrize("few, biased, seed", [(0, False, 0), (10_000, True, 3), (60, False, 1)])
def test_dense_negatives(spark, monkeypatch, few, biased, seed):
    e = materialise(as_edges(spark, [*TIES, (33, 1 << 40)]), "club")
    population = materialise(sampling.stubs(graph.symmetric(e), biased), "stubs")
    for name, x in (("SLICE", 100), ("FEW", few), ("CHUNK", 64), ("PART", 500)):
        monkeypatch.setattr(draws, name, x)
    got = sampling.negatives(population, e, 595, seed, max_rounds=3, pad=True)
    monkeypatch.setattr(sampling, "DENSE_NODES", 0)
    want = sampling.negatives(population, e, 595, seed, max_rounds=3, pad=True)
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == 595 and rows == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("biased", [False, True])
def test_draws_stop_when_enough(spark, monkeypatch, biased):
    """As many rows as asked for come from little more draws, and are those of all draws."""
    edges = materialise(spark.range(3000).selectExpr("id as src", "id + 1 as trg"), "line")
    population = materialise(sampling.stubs(graph.symmetric(edges), biased), "stubs")
    drawn = []
    real = sampling.draw_pairs
    monkeypatch.setattr(sampling, "draw_pairs", lambda p, size, *rest: drawn.append(size) or real(p, size, *rest))
    got = sampling.negatives(population, edges, 800)
    assert sum(drawn) <= 900
    every = real(population, 2400).where("x <> y").selectExpr("least(x, y) as src", "greatest(x, y) as trg", "draw").groupBy("src", "trg").agg({"draw": "min"})
    want = sorted((r[2], r[0], r[1]) for r in every.join(edges, ["src", "trg"], "left_anti").collect())[:800]
    assert sorted((r["draw"], r["src"], r["trg"]) for r in got.collect()) == want


def test_draws_go_on_when_too_few(spark):
    """A path's ends draw themselves and edges: the first round is too small, later ones fill up."""
    edges = materialise(spark.range(12).selectExpr("id as src", "id + 1 as trg"), "line")
    population = materialise(sampling.stubs(graph.symmetric(edges), False), "stubs")
    got = sampling._joined_draws(population, edges, 60, 0, 3, 4)
    assert got[1] >= 60 and got[2] in (67, 180, 720, 2340)
    assert sampling.negatives(population, edges, 60).count() == 60
