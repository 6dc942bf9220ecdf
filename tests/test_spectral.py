"""Spectral methods on graphs over their dense bound, against the dense results."""

import numpy as np
import pytest

from edgeloom.operators import embedding, features, graph, spectral
from edgeloom.operators.dataset import as_edges
from tests.test_graph import TIES


@pytest.fixture(scope="module")
def sym(spark):
    return graph.materialise(graph.symmetric(as_edges(spark, [*TIES, (33, 41), (41, 42), (42, 43), (43, 51)])), "club")


def vectors(df):
    return np.array([r["vec"] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("name", ["leigenmap", "adjspec", "modspec", "highorder_modularity", "linearized_node2vec", "nonbacktracking", "netmf", "spectral_transformation"])
def test_embeddings_over_the_dense_bound(sym, name):
    dense = vectors(embedding.EMBEDDINGS[name](sym, 3))
    held = vectors(embedding.EMBEDDINGS[name](sym, 3, max_nodes=5))
    sign = np.sign((dense * held).sum(axis=0))
    assert held.shape == dense.shape and held * sign == pytest.approx(dense, abs=1e-6)


@pytest.mark.parametrize("matrix", ["normalised", "laplacian"])
def test_transformed_matrices(sym, matrix):
    # With a given alpha: the training graph's largest eigenvalue is multiple, so its vectors are any basis.
    dense, held = (vectors(embedding.spectral_transformation(sym, 3, matrix=matrix, alpha=0.5, max_nodes=m)) for m in (5000, 5))
    assert np.abs(held) == pytest.approx(np.abs(dense), abs=1e-6)


def test_katz_over_the_dense_bound(sym):
    dense, held = ({r["u"]: r["katz"] for r in features.katz_centrality(sym, max_nodes=m).collect()} for m in (5000, 5))
    assert held == pytest.approx(dense, abs=1e-8)


def test_systems_that_are_nearly_singular():
    # Eigenvalues on both sides of 0, the nearest of them 7e-5 away.
    d = np.append(1 - 1.02 * np.cos(np.linspace(0, np.pi, 3000)), -1.7)
    x = spectral.solve(lambda y: d * y, np.ones(3001))
    assert np.linalg.norm(d * x - 1) <= 1e-8 * np.sqrt(3001)


def test_svd_features_over_the_dense_bound(sym):
    pairs = graph.upper_triangle(sym)
    dense, held = ({(r[0], r[1]): tuple(r[2:]) for r in features.approximate_svd_features(sym, pairs, max_nodes=m).collect()} for m in (5000, 5))
    assert held.keys() == dense.keys() and all(held[k] == pytest.approx(dense[k], abs=1e-8) for k in dense)


def test_magnitudes_that_hardly_differ():
    # Rotations by many angles, their radii 1e-4 apart, below one far larger eigenvalue.
    n, rng = 401, np.random.default_rng(1)
    radius, angle = 5 - 1e-4 * np.arange(200), rng.uniform(0.1, 3, 200)
    m = np.zeros((n, n))
    m[0, 0] = 27.0
    for i, (r, t) in enumerate(zip(radius, angle)):
        m[2 * i + 1 : 2 * i + 3, 2 * i + 1 : 2 * i + 3] = r * np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    s, x = spectral.top_eigen_general(lambda y: m @ y, n, 5, restarts=60)
    assert np.abs(s) == pytest.approx([27, 5, 5, 5 - 1e-4, 5 - 1e-4], abs=1e-6)
    assert np.abs(m @ x - x * s).max() < 1e-6


def parts(number, n=40, seed=5):
    """A chance graph's matrix, repeated, each copy tied to the next one by an edge."""
    rng = np.random.default_rng(seed)
    a = np.zeros((n, n))
    u, v = rng.integers(0, n, (2, 4 * n))
    a[u, v] = a[v, u] = 1.0
    np.fill_diagonal(a, 0)
    m = np.kron(np.eye(number), a)
    at = np.arange(number - 1) * n
    m[at, at + n + 1] = m[at + n + 1, at] = 1.0
    return m


def test_many_like_parts():
    m = parts(30)
    s, x = spectral.wide_eigen(lambda y: m @ y, len(m), 5, 1e-9, symmetric=True)
    assert s == pytest.approx(np.sort(np.linalg.eigvalsh(m))[::-1][:5], abs=1e-9)
    assert np.abs(m @ x - x * s).max() < 1e-9
    # Not symmetric: the matrix of walks that don't step back.
    k = m.sum(axis=1)
    b = np.block([[np.zeros_like(m), np.diag(k - 1)], [-np.eye(len(m)), m]])
    s, x = spectral.wide_eigen(lambda y: b @ y, len(b), 5, 1e-8)
    assert np.abs(s) == pytest.approx(np.sort(np.abs(np.linalg.eigvals(b)))[::-1][:5], abs=1e-6)


def test_no_gap_is_left_to_narrow_spaces():
    d = 1 - 1e-6 * np.arange(3000)
    assert spectral.wide_eigen(lambda y: d[:, None] * y, 3000, 5, 1e-12, symmetric=True) is None


def test_products_of_some_nodes_at_a_time(monkeypatch):
    from edgeloom.operators import around

    monkeypatch.setattr(around.Near, "ROWS", 16)
    a = parts(3)
    a[0, 1:60] = a[1:60, 0] = 1.0
    g = around.Graph(*np.nonzero(a))
    x = np.random.default_rng(0).standard_normal((len(a), 37))
    for most in (256, 4):
        assert around.Near(g, most).around(x) == pytest.approx(a @ x, abs=1e-12)


def test_hundreds_of_pairs_in_one_space():
    """No more than the space and some columns is held; the largest by magnitude are of both signs."""
    m, most = parts(12, 60), []
    s, x = spectral.filtered_eigen(lambda y: most.append(y.shape[1]) or m @ y, len(m), 27)
    want = np.linalg.eigvalsh(m)
    assert max(most) == 16 and s.min() < 0
    assert np.abs(s) == pytest.approx(np.sort(np.abs(want))[::-1][:27], abs=1e-8)
    assert np.abs(m @ x - x * s).max() < 1e-7


def test_svd_features_of_some_vectors_at_a_time(sym, monkeypatch):
    pairs = graph.upper_triangle(sym)
    want = {(r[0], r[1]): tuple(r[2:]) for r in features.approximate_svd_features(sym, pairs).collect()}
    monkeypatch.setattr(features, "SENT", 1000)
    got = {(r[0], r[1]): tuple(r[2:]) for r in features.approximate_svd_features(sym, pairs, max_nodes=5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
