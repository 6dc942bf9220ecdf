"""Work on edges that needs a number a node: tasks read the edges where they are and hold an array over all nodes,
the driver puts together what they send back. No edge is shuffled or written again.

``forest`` and ``counted`` give None for more than ``around.MAX_ENDS`` edge ends; the callers join instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import around
from edgeloom.operators.around import Arrays, folded


def _least(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its smallest value; all are numbers below ``n``."""
    both = np.unique(key.astype(np.int64) * n + value)
    key = both // max(n, 1)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first].astype(np.int32), (both[first] - key[first] * n).astype(np.int32)


def counted(rows: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted distinct values of the first column of (u, v), and their numbers of rows."""
    if rows.count() > (around.MAX_ENDS if most is None else most):
        return None
    ids, k = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for x, n in folded(rows.select(*(F.col(c).cast("long") for c in rows.columns[:2])), lambda u, _v: np.unique(u, return_counts=True)):
        new = np.union1d(ids, x)
        sums = np.zeros(len(new), dtype=np.int64)
        sums[np.searchsorted(new, ids)] = k
        sums[np.searchsorted(new, x)] += n
        ids, k = new, sums
    return ids, k


def _components(edges: DataFrame, ids: np.ndarray) -> np.ndarray:
    """For each node's number the smallest of its component: labels hook onto the least label next to them."""
    n = len(ids)

    def hooks(src: np.ndarray, trg: np.ndarray, ids: np.ndarray, label: np.ndarray) -> tuple:
        a, b = (label[np.searchsorted(ids, x)] for x in (src, trg))
        off = a != b
        return _least(np.maximum(a, b)[off], np.minimum(a, b)[off], len(ids))

    label = np.arange(n, dtype=np.int32)
    while True:
        up, moved = np.arange(n, dtype=np.int32), False
        for high, low in folded(edges, hooks, ids, label):
            up[high] = np.minimum(up[high], low)
            moved = moved or len(high) > 0
        if not moved:
            return label
        while not np.array_equal(up, up[up]):
            up = up[up]
        label = up[label]


def _levels(edges: DataFrame, ids: np.ndarray, roots: np.ndarray) -> np.ndarray:
    def reached(src: np.ndarray, trg: np.ndarray, ids: np.ndarray, level: np.ndarray) -> tuple:
        u, v = (np.searchsorted(ids, x).astype(np.int32) for x in (src, trg))
        a, b, d = level[u], level[v], level.max()
        return (np.unique(np.concatenate([v[(a == d) & (b < 0)], u[(b == d) & (a < 0)]])),)

    level = np.full(len(ids), -1, dtype=np.int32)
    level[roots] = d = 0
    while (level < 0).any():
        d += 1
        for (new,) in folded(edges, reached, ids, level):
            level[new] = d
    return level


def forest(edges: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, parent): the sorted nodes of a graph of (src, trg) without self-loops, and for each the number of its smallest
    neighbour one level up in the breadth-first search from its component's smallest node; a root has itself."""
    if 2 * edges.count() > (around.MAX_ENDS if most is None else most):
        return None
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("trg").cast("long").alias("trg"))
    ids = np.zeros(0, dtype=np.int64)
    for (x,) in folded(edges, lambda src, trg: (np.union1d(src, trg),)):
        ids = np.union1d(ids, x)
    label = _components(edges, ids)
    level = _levels(edges, ids, np.flatnonzero(label == np.arange(len(ids))))

    def parents(src: np.ndarray, trg: np.ndarray, ids: np.ndarray, level: np.ndarray) -> tuple:
        u, v = (np.searchsorted(ids, x) for x in (src, trg))
        off = level[u] != level[v]
        u, v = u[off], v[off]
        down = level[u] < level[v]
        return _least(np.where(down, v, u), np.where(down, u, v), len(ids))

    parent = np.full(len(ids), np.iinfo(np.int32).max, dtype=np.int32)
    for child, up in folded(edges, parents, ids, level):
        parent[child] = np.minimum(parent[child], up)
    roots = level == 0
    parent[roots] = np.flatnonzero(roots)
    return ids, parent


def in_forest(edges: DataFrame, found: tuple[np.ndarray, np.ndarray], inside: bool) -> DataFrame:
    """The edges with src < trg that join a node and its parent; or all others."""
    sent = edges.sparkSession.sparkContext.broadcast(Arrays(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parent = sent.value.arrays
        for b in batches:
            src, trg = (b.column(b.schema.get_field_index(c)) for c in ("src", "trg"))
            ok = src.is_valid().to_numpy(False) & trg.is_valid().to_numpy(False)
            src, trg = (x.fill_null(0).to_numpy().astype(np.int64) for x in (src, trg))
            at = np.flatnonzero(ok & (src < trg))
            u, v = (np.searchsorted(ids, x[at]) for x in (src, trg))
            tree = np.zeros(b.num_rows, dtype=bool)
            tree[at] = (parent[u] == v) | (parent[v] == u)
            yield b.filter(pa.array(tree if inside else ~tree))

    return edges.mapInArrow(run, edges.schema)


def smallest(rows: DataFrame, key: str, n: int) -> tuple[int, int, int] | None:
    """(cut, rows below it, rows at it) of an integer column: the ``n`` smallest rows are those below the cut and some at
    it. Counted in ever narrower ranges, by thousands; None if there are no more than ``n`` rows."""
    k = F.col(key).cast("long")
    low, high, total = rows.agg(F.min(k), F.max(k), F.count(k)).first()
    if total <= n:
        return None
    below = 0
    while True:
        width = -(-(high - low + 1) // 4096)
        part = F.expr(f"(cast({key} as bigint) - {low}) div {width}")
        counts = rows.where(k.between(low, high)).groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()
        for p, c in sorted(map(tuple, counts)):
            if below + c > n:
                break
            below += c
        if width == 1:
            return low + p, below, c
        low, high = low + p * width, min(high, low + (p + 1) * width - 1)
