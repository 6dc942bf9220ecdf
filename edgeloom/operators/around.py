"""Work around single nodes, done where the node is: every task holds the graph, and no wedge is shuffled.

``held`` sends a graph to the tasks as sorted neighbour lists of 32-bit numbers (4 bytes an edge end, 16
a node) if it has ``MAX_ENDS`` edge ends at most. A larger graph isn't refused: ``held`` gives None, and the
callers join instead. Blocks are cut by the number of entries that they make, so a hub's block is
short.
"""

from __future__ import annotations

import pickle
import weakref
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edge ends of a graph that is sent to the tasks: 256 MB of neighbours. Larger ones are joined.
MAX_ENDS = 64_000_000
#: Entries that a block makes at once.
BLOCK = 2_000_000


def packed(x: np.ndarray) -> tuple[str, list[bytes]]:
    """Whole numbers as the steps between them, a byte's plane at a time."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return x.dtype.str, [zlib.compress(plane.tobytes(), 1) for plane in steps.view(np.uint8).reshape(-1, x.itemsize).T]


def unpacked(state: tuple[str, list[bytes]]) -> np.ndarray:
    kind, planes = state
    planes = [np.frombuffer(zlib.decompress(p), np.uint8) for p in planes]
    return np.cumsum(np.stack(planes, axis=1).view(kind).ravel(), dtype=kind)


def keys(u: np.ndarray, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries of a matrix over ``ids``, numbered by row and column."""
    key = np.searchsorted(ids, u).astype(np.int64)
    key *= len(ids)
    key += np.searchsorted(ids, v)
    return key


class Graph:
    """ids (sorted), and for node number i its neighbours' numbers near[at[i]:at[i + 1]], sorted."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        ids = np.union1d(np.unique(u), np.unique(v)).astype(np.int64)
        self._fill(ids, keys(u, v, ids))

    @classmethod
    def keyed(cls, ids: np.ndarray, key: np.ndarray) -> Graph:
        """Of all nodes and ``keys``, which it overwrites."""
        g = cls.__new__(cls)
        g._fill(ids, key)
        return g

    def _fill(self, ids: np.ndarray, key: np.ndarray) -> None:
        self.ids, n = ids, len(ids)
        key.sort()
        self.at = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n)
        key %= max(n, 1)
        self.near = key.astype(np.int32)
        self.k = np.diff(self.at)

    def __getstate__(self) -> tuple:
        # Every executor and the driver write what is sent to disk.
        return tuple(map(packed, (self.ids, self.at, self.near)))

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.at, self.near = map(unpacked, state)
        self.k = np.diff(self.at)

    def number(self, ids) -> np.ndarray:
        """Nodes' numbers, -1 for an id that isn't in the graph."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(self.ids):
            return np.full(len(ids), -1)
        i = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[i] == ids, i, -1)

    def spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, neighbour): all neighbours of each of ``nodes``, with the node's place in the list."""
        k = self.k[nodes]
        entry = np.repeat(np.arange(len(nodes)), k)
        first = np.cumsum(k) - k
        return entry, self.near[np.arange(len(entry)) + np.repeat(self.at[nodes] - first, k)].astype(np.int64)

    def linked(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether v is in u's list, by binary search of all at once."""
        lo, hi = self.at[u], self.at[u + 1]
        end = hi.copy()
        for _ in range(int(self.k.max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.near[np.minimum(mid, len(self.near) - 1)] < v)
            hi = np.where(less | (lo >= hi), hi, mid)
            lo = np.where(less, mid + 1, lo)
        return (lo < end) & (self.near[np.minimum(lo, len(self.near) - 1)] == v)

    def around(self, x: np.ndarray) -> np.ndarray:
        """Sums of ``x`` (a row for each node) over each node's neighbours."""
        out = np.zeros_like(x)
        some = np.flatnonzero(self.k)
        if len(some):
            out[some] = np.add.reduceat(x[self.near], self.at[some], axis=0)
        return out


class Arrays:
    """Arrays of whole numbers, small when pickled."""

    def __init__(self, *arrays: np.ndarray):
        self.arrays = arrays

    def __getstate__(self) -> list:
        return [packed(x) for x in self.arrays]

    def __setstate__(self, state: list) -> None:
        self.arrays = tuple(map(unpacked, state))


def folded(edges: DataFrame, work: Callable[..., tuple], *shared: np.ndarray) -> Iterator[tuple]:
    """The arrays that ``work(one, two, *shared)`` makes of the edges' two columns of longs, some millions at a time."""
    sent = edges.sparkSession.sparkContext.broadcast(Arrays(*shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def made() -> pa.RecordBatch:
            out = work(*(np.concatenate([h[c] for h in held]) for c in (0, 1)), *sent.value.arrays)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Arrays(*out))], pa.binary())], ["x"])

        for b in batches:
            held.append([b.column(c).to_numpy() for c in (0, 1)])
            rows += b.num_rows
            if rows >= BLOCK:
                yield made()
                held, rows = [], 0
        if rows:
            yield made()

    try:
        rows = edges.mapInArrow(run, "x binary").collect()
        while rows:
            yield pickle.loads(rows.pop()["x"]).arrays
    finally:
        sent.destroy()


class Slots:
    """``Graph.around`` for many products: the first neighbours of all nodes at once, then the second ones and so
    on up to ``most``; what is beyond that, of hubs, is summed as in ``Graph``."""

    def __init__(self, g: Graph, most: int = 256):
        order = np.argsort(-g.k, kind="stable")
        down = -g.k[order]
        self.slots = []
        for j in range(min(int(g.k.max(initial=0)), most)):
            nodes = order[: np.searchsorted(down, -j, "left")]
            self.slots.append(g.near[g.at[nodes] + j])
        self.order, self.place = order, np.argsort(order)
        hubs = order[: np.searchsorted(down, -most, "left")]
        entry, self.rest = Slots._after(g, hubs, most)
        self.starts = np.flatnonzero(np.diff(entry, prepend=-1))

    @staticmethod
    def _after(g: Graph, hubs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        entry, near = g.spread(hubs)
        first = np.cumsum(g.k[hubs]) - g.k[hubs]
        late = np.arange(len(entry)) - first[entry] >= most
        return entry[late], near[late]

    def around(self, x: np.ndarray) -> np.ndarray:
        out, some = np.zeros_like(x), np.empty_like(x)
        for s in self.slots:
            np.take(x, s, axis=0, out=some[: len(s)], mode="clip")
            out[: len(s)] += some[: len(s)]
        if len(self.starts):
            out[: len(self.starts)] += np.add.reduceat(x[self.rest], self.starts, axis=0)
        return out[self.place]


class Near:
    """``Slots`` of some thousand nodes at a time: where neighbours' numbers are near each other, as in a graph of
    parts, a processor's cache has the rows. It works on some columns at a time, as much as are fast."""

    ROWS, COLUMNS = 2048, 16

    def __init__(self, g: Graph, most: int = 256):
        self.parts = []
        for lo in range(0, len(g.ids), self.ROWS):
            k = g.k[lo : lo + self.ROWS]
            order = np.argsort(-k, kind="stable")
            down, slots = -k[order], []
            for j in range(min(int(k.max(initial=0)), most)):
                slots.append(g.near[g.at[lo + order[: np.searchsorted(down, -j, "left")]] + j])
            hubs = order[: np.searchsorted(down, -most, "left")]
            entry, rest = Slots._after(g, lo + hubs, most)
            self.parts.append((slice(lo, lo + len(k)), slots, np.argsort(order), rest, np.flatnonzero(np.diff(entry, prepend=-1))))

    def around(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] > self.COLUMNS:
            return np.concatenate([self.around(x[:, c : c + self.COLUMNS]) for c in range(0, x.shape[1], self.COLUMNS)], axis=1)
        x = np.ascontiguousarray(x)
        out, some, total = np.empty_like(x), *(np.empty((self.ROWS, x.shape[1])) for _ in range(2))
        for rows, slots, place, rest, starts in self.parts:
            total[:] = 0
            for s in slots:
                np.take(x, s, axis=0, out=some[: len(s)], mode="clip")
                total[: len(s)] += some[: len(s)]
            if len(starts):
                total[: len(starts)] += np.add.reduceat(x[rest], starts, axis=0)
            np.take(total, place, axis=0, out=out[rows], mode="clip")
        return out


_HELD: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def collected(sym: DataFrame) -> Graph:
    """The graph on the driver, from the tasks' sorted and packed entries."""
    ends = sym.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    ids, key, at = np.zeros(0, dtype=np.int64), np.zeros(sym.count(), dtype=np.int64), 0
    for (x,) in folded(ends, lambda u, v: (np.union1d(u, v),)):
        ids = np.union1d(ids, x)
    for (x,) in folded(ends, lambda u, v, ids: (np.sort(keys(u, v, ids)),), ids):
        key[at : at + len(x)] = x
        at += len(x)
    return Graph.keyed(ids, key)


def held(sym: DataFrame, most: int | None = None) -> Broadcast | None:
    """The graph for all tasks, sent once for a DataFrame; None if it has over ``most`` (MAX_ENDS) edge ends."""
    most = MAX_ENDS if most is None else most
    if sym not in _HELD:
        if sym.count() > most:
            return None
        _HELD[sym] = sym.sparkSession.sparkContext.broadcast(collected(sym))
    return _HELD[sym]


def cut(sizes: np.ndarray, block: int | None = None) -> Iterator[slice]:
    """Slices whose sizes sum to ``block`` at most, or of one element."""
    total, lo = np.cumsum(sizes), 0
    block = BLOCK if block is None else block
    while lo < len(sizes):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + block, "right")))
        yield slice(lo, hi)
        lo = hi


def summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of ``x`` by key."""
    if not len(key):
        return key, x
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(x[order], first)


def common(g: Graph, i: np.ndarray, j: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each pair of numbers, sums of each of ``weights`` over the common neighbours."""
    out = [np.zeros(len(i)) for _ in weights]
    ok = np.flatnonzero((i >= 0) & (j >= 0))
    a, b = i[ok], j[ok]
    a, b = np.where(g.k[a] <= g.k[b], a, b), np.where(g.k[a] <= g.k[b], b, a)
    for s in cut(g.k[a]):
        entry, z = g.spread(a[s])
        hit = g.linked(b[s][entry], z)
        entry, z = entry[hit], z[hit]
        for o, w in zip(out, weights):
            o[ok[s]] = np.bincount(entry, weights=w[z], minlength=len(a[s]))
    return out


def three(g: Graph, i: np.ndarray, j: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each pair, sums of the products of both inner nodes' weights over the walks of length three."""
    out = [np.zeros(len(i)) for _ in weights]
    ok = np.flatnonzero((i >= 0) & (j >= 0))
    if not len(ok):
        return out
    size = g.k[i[ok]] * g.k[j[ok]]
    for s in cut(size):
        rows = ok[s]
        if len(rows) == 1 and size[s][0] > BLOCK:
            # Two hubs: no more than the neighbours' lists are read.
            y = [np.zeros(len(g.ids)) for _ in weights]
            for w, one in zip(weights, y):
                n = g.near[g.at[j[rows[0]]] : g.at[j[rows[0]] + 1]]
                one[n] = w[n]
            z = g.near[g.at[i[rows[0]]] : g.at[i[rows[0]] + 1]].astype(np.int64)
            for part in cut(g.k[z]):
                entry, x = g.spread(z[part])
                for o, w, one in zip(out, weights, y):
                    o[rows[0]] += float((w[z[part]][entry] * one[x]).sum())
            continue
        e, z = g.spread(i[rows])
        e2, x = g.spread(j[rows][e])
        z, e = z[e2], e[e2]
        hit = g.linked(z, x)
        e, z, x = e[hit], z[hit], x[hit]
        for o, w in zip(out, weights):
            o[rows] = np.bincount(e, weights=w[z] * w[x], minlength=len(rows))
    return out


def inverse(k: np.ndarray) -> np.ndarray:
    return 1.0 / np.maximum(k, 1)


def entries_of(g: Graph, steps: int) -> np.ndarray:
    """At most so many entries come from each node in its widest step: walks, or all edge ends if fewer."""
    size = g.k.astype(float)
    most = size.copy()
    for _ in range(steps - 1):
        size = np.minimum(g.around(size[:, None])[:, 0], float(len(g.near)))
        most = np.maximum(most, size)
    return most


def step_sums(g: Graph, key: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One step of walks: entries (row * n + node, mass) to the neighbours in equal parts, summed by key."""
    n = len(g.ids)
    z = key % n
    e, v = g.spread(z)
    to = (key - z)[e] + v
    mass = (x / np.maximum(g.k[z], 1))[e]
    if 4 * len(to) > rows * n:
        full = np.bincount(to, weights=mass, minlength=rows * n)
        at = np.flatnonzero(full)
        return at, full[at]
    return summed(to, mass)


def without(keys: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """Sorted keys that are in none of the sorted ``known``."""
    for other in known:
        if len(other):
            keys = keys[other[np.minimum(np.searchsorted(other, keys), len(other) - 1)] != keys]
    return keys


def hops(g: Graph, i: np.ndarray, j: np.ndarray, most: int | None = None) -> np.ndarray:
    """The distance of each pair of numbers, -1 if no path (of ``most`` hops) joins them. Both ends are
    searched, the cheaper one next; a block whose next step is too large is halved."""
    n = max(len(g.ids), 1)
    out = np.full(len(i), -1)
    out[i == j] = 0
    p = np.flatnonzero((i != j) & (i >= 0) & (j >= 0))
    none = np.zeros(0, dtype=np.int64)
    stack = [(p, [p * n + i[p], none], [p * n + j[p], none], 0)] if len(p) else []
    while stack:
        p, one, two, d = stack.pop()
        while len(p) and (most is None or d < most):
            a, b = (int(g.k[x[0] % n].sum()) for x in (one, two))
            if min(a, b) > BLOCK and len(p) > 1:
                mid = p[len(p) // 2] * n
                for part, side in ((p[: len(p) // 2], lambda x: x < mid), (p[len(p) // 2 :], lambda x: x >= mid)):
                    stack.append((part, *([x[side(x)] for x in s] for s in (one, two)), d))
                break
            if b < a:
                one, two = two, one
            e, v = g.spread(one[0] % n)
            # Neighbours of a level are on it, next to it or new.
            new = without(np.unique((one[0] // n)[e] * n + v), *one)
            one, d = [new, one[0]], d + 1
            met = np.unique(new[np.isin(new, two[0], assume_unique=True)] // n)
            out[met] = d
            p = np.setdiff1d(np.intersect1d(one[0] // n, two[0] // n), met, assume_unique=True)
            one, two = ([x[np.isin(x // n, p)] for x in s] for s in (one, two))
    return out


def levels(g: Graph, block: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of distances, number) of the block's other nodes that each node reaches, 64 searches a word."""
    n, m = len(g.ids), len(block)
    seen = np.zeros((n, -(-m // 64)), dtype=np.uint64)
    seen[block, np.arange(m) // 64] = np.uint64(1) << (np.arange(m) % 64).astype(np.uint64)
    front, active = seen.copy(), np.sort(block)
    far, number, d = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
    while len(active) and (most is None or d < most):
        d += 1
        rows = np.unique(g.spread(active)[1])
        rows = rows[g.k[rows] > 0]
        if not len(rows):
            break
        _e, x = g.spread(rows)
        new = np.bitwise_or.reduceat(front[x], np.cumsum(g.k[rows]) - g.k[rows], axis=0) & ~seen[rows]
        front[active] = 0
        front[rows] = new
        seen[rows] |= new
        count = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        far[rows] += d * count
        number[rows] += count
        active = rows[count > 0]
    return far, number


def flows(g: Graph, block: np.ndarray, load: bool = False, weight: np.ndarray | None = None) -> np.ndarray:
    """Each node's share of the shortest paths from the block's nodes to all others (the ends not counted), a node's
    paths counted as often as its ``weight`` (1), at either end."""
    weight = np.ones(len(g.ids)) if weight is None else weight.astype(float)
    n, m = len(g.ids), len(block)
    level, paths = np.full(m * n, -1, dtype=np.int32), np.zeros(m * n)
    ups, tag = np.zeros(m * n), np.zeros(m * n, dtype=np.int64)
    front = np.arange(m) * n + block
    level[front], paths[front] = 0, 1.0
    fronts = []
    while len(front):
        fronts.append(front)
        z = front % n
        e, v = g.spread(z)
        to = (front - z)[e] + v
        ok = level[to] == -1
        to, e = to[ok], e[ok]
        np.add.at(paths, to, paths[front[e]])
        if load:
            np.add.at(ups, to, 1.0)
        # Each new node once: the last of those that wrote their place.
        tag[to] = np.arange(len(to))
        level[to] = len(fronts)
        front = to[tag[to] == np.arange(len(to))]
    flow = np.zeros(m * n)
    for d in range(len(fronts) - 1, 0, -1):
        w = fronts[d]
        z = w % n
        e, v = g.spread(z)
        to = (w - z)[e] + v
        up = level[to] == d - 1
        to, e = to[up], e[up]
        share = (weight[z] + flow[w]) / (ups[w] if load else paths[w])
        np.add.at(flow, to, share[e] * (1.0 if load else paths[to]))
    flow[np.arange(m) * n + block] = 0.0
    return weight[block] @ flow.reshape(m, n)
