"""Negatives of a graph so dense that more pairs are drawn than there are: the draws are made in tasks, not joined.

A draw's ends are multiples of its number modulo a prime, so a task makes millions a second and needs none
of another's. While most pairs are open, each task has a slice of all pairs and goes through all draws; later
each goes through a part of the draws and looks for the pairs that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import materialise

PRIME = 2147483647
#: Pairs of a slice: 56 MB of first draws. Open pairs up to which the draws are dealt, not the pairs.
SLICE, FEW = 7_000_000, 4_000_000
#: Draws made at once, and of a task that has a part of them.
CHUNK, PART = 1 << 18, 16_000_000


class Draws:
    """Pairs drawn from ``population`` (numbers of nodes, by place) as ``sampling.draw_pairs`` draws them."""

    def __init__(self, population: np.ndarray, seed: int):
        self.population, self.seed = population.astype(np.int32), seed
        self.ends = [(48271 * 16807 % PRIME, 1 + 2 * seed), (69621 * 39373 % PRIME, 2 + 2 * seed)]
        self.steps = [(np.arange(CHUNK, dtype=np.int64) * (2 * c % PRIME) % PRIME).astype(np.uint32) for c, _ in self.ends]

    def pairs(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Smaller and larger end of the draws at .. to - 1, of at most ``CHUNK``."""
        found = []
        for (c, first), steps in zip(self.ends, self.steps):
            u = steps[: to - at] + np.uint32((2 * at + first) * c % PRIME)
            u = np.minimum(u, u - np.uint32(PRIME))
            m = np.uint32(len(self.population))
            found.append(self.population[u - u // m * m])
        return np.minimum(*found), np.maximum(*found)


def _open_rows(n: int, gone: np.ndarray) -> np.ndarray:
    """A row of bits for each smaller end: pairs of different nodes but those ``gone`` (n, 2)."""
    bits = np.zeros((n, -(-n // 8)), dtype=np.uint8)
    gone = gone[np.argsort(gone[:, 0], kind="stable")]
    ends = np.searchsorted(gone[:, 0], np.arange(n + 1))
    for i in range(n):
        row = np.arange(n) > i
        row[gone[ends[i] : ends[i + 1], 1]] = False
        bits[i] = np.packbits(row)
    return bits


def _slices(n: int) -> list[tuple[int, int]]:
    """Ranges of smaller ends with about ``SLICE`` pairs each."""
    total = np.cumsum(n - 1 - np.arange(n))
    cuts = np.searchsorted(total, np.arange(SLICE, max(int(total[-1]), 1), SLICE), "right")
    edges = np.unique(np.concatenate([[0], cuts, [n]]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _by_slices(spark, shared, n: int, start: int, count: int) -> DataFrame:
    """(row, src, trg, draw, found): for each smaller end its open pairs that were drawn, with their first draws."""
    slices = _slices(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, ids, bits = shared.value
        for b in batches:
            for lo, hi in (slices[i] for i in b.column("id").to_pylist()):
                rows = np.arange(lo, hi)
                first_of = np.concatenate([[0], np.cumsum(n - 1 - rows)])
                # A pair's place is its row's base plus its larger end.
                base = first_of[:-1] - rows - 1
                first = np.full(first_of[-1], -1, dtype=np.int64)
                # Later draws first, so that the first one stays.
                for at in range(start + (count - 1) // CHUNK * CHUNK, start - 1, -CHUNK):
                    x, y = drawn.pairs(at, min(at + CHUNK, start + count))
                    ok = np.flatnonzero((x >= lo) & (x < hi) & (x != y))[::-1]
                    first[base[x[ok] - lo] + y[ok]] = at + ok
                out = []
                for i in range(hi - lo):
                    here = np.zeros(n, dtype=bool)
                    here[lo + i + 1 :] = first[first_of[i] : first_of[i + 1]] >= 0
                    here &= np.unpackbits(bits[lo + i], count=n).astype(bool)
                    trg = np.flatnonzero(here)
                    out.append((lo + i, ids[lo + i], ids[trg], first[base[i] + trg], np.packbits(here).tobytes()))
                    if len(out) == 64 or i == hi - lo - 1:
                        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["row", "src", "trg", "draw", "found"])
                        out = []

    made = spark.range(0, len(slices), 1, len(slices))
    return made.mapInArrow(run, "row int, src long, trg array<long>, draw array<long>, found binary")


def _by_parts(spark, shared, start: int, count: int) -> DataFrame:
    """(src, trg, draw): the open pairs that were drawn, numbers of nodes, with their first draws."""
    parts = -(-count // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, _ids, bits = shared.value
        some = bits.any(axis=1)
        for b in batches:
            for part in b.column("id").to_pylist():
                end = min(start + (part + 1) * PART, start + count)
                for at in range(start + part * PART, end, CHUNK):
                    x, y = drawn.pairs(at, min(at + CHUNK, end))
                    ok = np.flatnonzero(some[x] & (x != y))
                    ok = ok[(bits[x[ok], y[ok] >> 3] >> (7 - (y[ok] & 7)).astype(np.uint8)) & 1 == 1]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (x[ok], y[ok], at + ok)], ["src", "trg", "draw"])

    made = spark.range(0, parts, 1, parts).mapInArrow(run, "src long, trg long, draw long")
    return made.groupBy("src", "trg").agg(F.min("draw").alias("draw"))


def first_draws(population: DataFrame, exclude: DataFrame, size: int, seed: int, oversample: int, max_rounds: int) -> tuple[DataFrame, int, int]:
    """What the rounds of ``sampling.negatives`` find: (src, trg, draw), their number, and the number of the last round's first draw."""
    spark = population.sparkSession
    nodes = population.orderBy("i").select("node").toArrow().column("node").to_numpy()
    ids, numbers = np.unique(nodes, return_inverse=True)
    known = exclude.select("src", "trg").distinct().toArrow()
    gone = [known.column(c).to_numpy() for c in ("src", "trg")]
    gone = np.stack([np.minimum(*gone), np.maximum(*gone)], axis=1)
    gone = gone[np.isin(gone, ids).all(axis=1)]
    n, drawn = len(ids), Draws(numbers, seed)
    bits = _open_rows(n, np.searchsorted(ids, gone))
    left, total, start, kept = int(np.bitwise_count(bits).sum()), 0, 0, None
    for _ in range(max_rounds):
        if left:
            shared = spark.sparkContext.broadcast((drawn, ids, bits))
            if left > FEW:
                got = materialise(_by_slices(spark, shared, n, start, oversample * size), "negatives")
                found = got.select("row", "found").toArrow()
                for row, x in zip(found.column("row").to_pylist(), found.column("found").to_pylist()):
                    bits[row] &= ~np.frombuffer(x, dtype=np.uint8)
                got = got.select("src", F.explode(F.arrays_zip("trg", "draw")).alias("x")).select("src", "x.trg", "x.draw")
            else:
                rows = _by_parts(spark, shared, start, oversample * size).toArrow()
                x, y = (rows.column(c).to_numpy() for c in ("src", "trg"))
                np.bitwise_and.at(bits, (x, y >> 3), ~(np.uint8(128) >> (y & 7).astype(np.uint8)))
                made = pa.table({"src": ids[x], "trg": ids[y], "draw": rows.column("draw")})
                got = materialise(spark.createDataFrame(made, "src long, trg long, draw long"), "negatives")
            shared.unpersist()
            kept = got if kept is None else kept.unionByName(got)
            before, left = left, int(np.bitwise_count(bits).sum())
            total += before - left
        if total >= size:
            break
        start, oversample = start + oversample * size, oversample * 3
    return kept if kept is not None else exclude.select("src", "trg", F.lit(0).cast("long").alias("draw")).limit(0), total, start
