"""Hold-out of edges that keeps the training graph connected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import folds
from edgeloom.operators.graph import drop_self_loops, global_rank, spanning_forest
from edgeloom.storage import materialise, settled


def mixed(seed: int = 0) -> Column:
    """An integer hash of an edge that SQL computes alike; the order of the draw."""
    return (F.col("src") * 73856093 + F.col("trg") * 19349663 + F.lit(seed)) % 1000003


def test_of(edges: DataFrame, fraction: float, seed: int = 0, tolerant: bool = False) -> DataFrame:
    """floor(m * fraction) edges outside a spanning forest.

    Raises ValueError if fewer edges are outside the forest. ``tolerant`` never raises: above the
    largest possible fraction it uses half of that, and counts from the edges outside the forest.
    """
    edges = materialise(edges, "split-edges")
    found = folds.forest(drop_self_loops(edges))
    if found is not None:
        rest = folds.in_forest(edges.select("src", "trg"), found, False)
    else:
        rest = settled(lambda: edges.join(spanning_forest(edges), ["src", "trg"], "left_anti"), "split-rest")
    m, free = edges.count(), rest.count()
    if tolerant:
        most = free / m if m else 0.0
        n = int((0.5 * most if fraction > most else fraction) * free)
    else:
        n = int(m * fraction)
        if n > free:
            raise ValueError(f"{n} test edges asked for, {free} can be removed without disconnecting the graph")
    return settled(lambda: _first(rest.withColumn("h", mixed(seed)), n).select("src", "trg"), "split-test")


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by (h, src, trg). Only rows whose hash is that of the last one are sorted."""
    cut = folds.smallest(rows, "h", n)
    if cut is None:
        return rows
    h, below, _ = cut
    return rows.where(F.col("h") < h).unionByName(global_rank(rows.where(F.col("h") == h), ["src", "trg"]).where(F.col("rank") < n - below).drop("rank"))


def held_out(edges: DataFrame, fraction: float, seed: int = 0, tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(test, train): ``test_of`` the edges, and all others."""
    edges = materialise(edges, "split-edges")
    test = test_of(edges, fraction, seed, tolerant)
    return test, materialise(edges.join(test, ["src", "trg"], "left_anti"), "split-train")


def nested_hold_out(edges: DataFrame, fraction: float, seed: int = 0) -> dict[str, DataFrame]:
    """original -> held-out -> training: the split applied twice, with both levels' test edges."""
    outer_test, heldout = held_out(edges, fraction, seed)
    inner_test, train = held_out(heldout, fraction, seed + 1)
    return {"heldout": heldout, "heldout_test": outer_test, "train": train, "train_test": inner_test}
