"""Node and edge samplers. Draws are integer hashes of their number, so any engine repeats them.

A sampler numbers its population from 0 (a list of stubs); a draw picks the row with its hash modulo
the list's length by an equi-join. Drawing in proportion to degree is drawing from the list of edge
ends, where a node of degree k stands k times.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from edgeloom.operators import draws, folds
from edgeloom.operators.around import MAX_ENDS
from edgeloom.operators.graph import canonical_edges, degrees, global_rank, symmetric
from edgeloom.storage import materialise, shuffle_width

_PRIME = draws.PRIME
#: Nodes up to which a dense graph's negatives are drawn in tasks: 50 MB of bits for the open pairs.
DENSE_NODES = 20_000


def first_end(d: Column, seed: int = 0) -> Column:
    return ((d * 2 + 1 + 2 * seed) * 48271 % _PRIME) * 16807 % _PRIME


def second_end(d: Column, seed: int = 0) -> Column:
    return ((d * 2 + 2 + 2 * seed) * 69621 % _PRIME) * 39373 % _PRIME


def stubs(sym: DataFrame, degree_biased: bool) -> DataFrame:
    """(i, node): edge ends in order (u, v) or nodes in order, numbered from 0."""
    if degree_biased:
        return global_rank(sym, ["u", "v"], "i").select("i", F.col("u").alias("node"))
    return global_rank(sym.select("u").distinct(), ["u"], "i").select("i", F.col("u").alias("node"))


class Ends:
    """``stubs`` that are no rows: the nodes in order, and how many stubs there are up to each. Tasks that hold these
    look a draw's place up, so nothing is joined."""

    def __init__(self, spark: SparkSession, ids: np.ndarray, k: np.ndarray):
        self.sparkSession, self.nodes, self.total = spark, len(ids), int(k.sum())
        self._sent = spark.sparkContext.broadcast(folds.Arrays(ids, np.cumsum(k)))

    def count(self) -> int:
        return self.total

    def looked_up(self, rows: DataFrame, **places: str) -> DataFrame:
        """``rows`` with each of ``places`` (new column=column of numbers from 0) replaced by the node that stands there."""
        sent, old = self._sent, list(places.values())
        rest = [c for c in rows.columns if c not in old]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, upto = sent.value.arrays
            for b in batches:
                at = [np.searchsorted(upto, b.column(b.schema.get_field_index(c)).to_numpy(), "right") for c in old]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), *(pa.array(ids[x]) for x in at)], [*rest, *places])

        return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in rest), *(StructField(c, LongType()) for c in places)]))

    def table(self) -> DataFrame:
        numbers = self.sparkSession.range(self.total).select(F.col("id").alias("i"), F.col("id").alias("at"))
        return self.looked_up(numbers, node="at")


_COUNTED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ends(sym: DataFrame, degree_biased: bool) -> Ends | None:
    """``stubs`` as ``Ends``; None if the graph is too large for its nodes to be held."""
    if sym not in _COUNTED:
        _COUNTED[sym] = folds.counted(sym)
    if _COUNTED[sym] is None:
        return None
    ids, k = _COUNTED[sym]
    return Ends(sym.sparkSession, ids, k if degree_biased else np.ones_like(k))


def membership_stubs(nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """(i, node) of any node table, each as often as its integer ``weight``."""
    rows = nodes if weight is None else nodes.withColumn("__r", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))))
    return global_rank(rows, ["node"] if weight is None else ["node", "__r"], "i").select("i", "node")


def sample_nodes(population: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(draw, node): ``size`` draws with replacement."""
    m = population.count()
    draws = population.sparkSession.range(size).select(F.col("id").alias("draw"), (first_end(F.col("id"), seed) % m).alias("i"))
    return draws.join(population, "i").select("draw", "node")


def draw_pairs(population: DataFrame | Ends, size: int, start: int = 0, seed: int = 0) -> DataFrame:
    """(draw, x, y): pairs of independent draws numbered from ``start``."""
    m, spark = population.count(), population.sparkSession
    return _with_ends(spark.range(start, start + size, 1, shuffle_width(spark)).select(F.col("id").alias("draw")), population, m, seed)


def _with_ends(drawn: DataFrame, population: DataFrame | Ends, m: int, seed: int) -> DataFrame:
    """Rows with a ``draw``, and its pair x, y of a population of ``m``."""
    rest = drawn.columns
    d = drawn.select("*", (first_end(F.col("draw"), seed) % m).alias("a"), (second_end(F.col("draw"), seed) % m).alias("b"))
    if isinstance(population, Ends):
        return population.looked_up(d, x="a", y="b")
    one = d.join(population.select(F.col("i").alias("a"), F.col("node").alias("x")), "a")
    return one.join(population.select(F.col("i").alias("b"), F.col("node").alias("y")), "b").select(*rest, "x", "y")


def negatives(population: DataFrame | Ends, exclude: DataFrame, size: int, seed: int = 0, oversample: int = 3, max_rounds: int = 10, pad: bool = False) -> DataFrame:
    """(src, trg, draw): ``size`` distinct pairs of different nodes that are not in ``exclude``.

    One shot draws an eighth more than the size, the next one up to ``oversample`` times the size; if too few
    survive, later rounds draw more: by joins, or in tasks (``draws``) if at least as many pairs are drawn
    as there are. Later draws never displace earlier ones, so the rounds' sizes don't show. If the
    graph is too dense even then, ``pad`` fills up with accepted pairs, drawn with replacement; without it
    that is an error.
    """
    dense = seed >= 0 and _is_dense(population, oversample * size)
    if dense and isinstance(population, Ends):
        population = materialise(population.table(), "stubs")
    if dense:
        kept, total, start = draws.first_draws(population, exclude, size, seed, oversample, max_rounds)
    else:
        kept, total, start = _joined_draws(population, exclude, size, seed, oversample, max_rounds)
    if total < size and not pad:
        raise ValueError(f"{size} negatives asked for, {total} found in {max_rounds} rounds; pad repeats accepted pairs")
    if total >= size:
        # A draw has one pair: those below the cut are as many as asked for.
        cut = folds.smallest(kept, "draw", size)
        return (kept if cut is None else kept.where(F.col("draw") < cut[0])).select("src", "trg", "draw")
    out = kept.select("src", "trg", "draw")
    if total:
        # Only draws are ranked: the pair is drawn again from its draw.
        extra = kept.sparkSession.range(size - total).select((first_end(F.col("id"), seed + 1) % total).alias("i"), (F.lit(start) + F.col("id")).alias("again"))
        extra = extra.join(global_rank(kept.select("draw"), ["draw"], "i"), "i").select("draw", "again")
        pairs = _with_ends(extra, population, population.count(), seed)
        out = out.union(pairs.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("trg"), F.col("again").alias("draw")))
    return out


def _is_dense(population: DataFrame | Ends, drawn: int) -> bool:
    """Whether at least as many pairs are drawn as there are, of at most ``DENSE_NODES`` nodes."""
    n = population.nodes if isinstance(population, Ends) else population.select("node").distinct().count() if population.count() <= MAX_ENDS else 0
    return 1 < n <= DENSE_NODES and drawn >= n * (n - 1) // 2


def _joined_draws(population: DataFrame | Ends, exclude: DataFrame, size: int, seed: int, oversample: int, max_rounds: int) -> tuple[DataFrame, int, int]:
    upto, most = [], oversample * size
    for _ in range(max_rounds):
        upto.append((upto[-1] if upto else 0) + most)
        most *= 3
    # Mostly a little more than asked for is enough, and the rest need not be drawn.
    first = size + size // 8
    upto = [first, *upto] if 0 < first < upto[0] else upto
    kept, total, start = None, 0, 0
    for end in upto:
        drawn = draw_pairs(population, end - start, start, seed).where("x <> y")
        pairs = drawn.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("trg"), "draw")
        pairs = pairs.groupBy("src", "trg").agg(F.min("draw").alias("draw"))
        pairs = pairs.join(exclude.select("src", "trg"), ["src", "trg"], "left_anti")
        if kept is not None:
            pairs = pairs.join(kept.select("src", "trg"), ["src", "trg"], "left_anti").unionByName(kept)
        kept = materialise(pairs, "negatives")
        total = kept.count()
        if total >= size:
            break
        start = end
    return kept, total, start


def all_negatives(edges: DataFrame, nodes: DataFrame, max_nodes: int = 20_000) -> DataFrame:
    """Every pair src < trg of nodes without an edge. Quadratic by definition: refused above ``max_nodes``."""
    n = nodes.count()
    if n > max_nodes:
        raise ValueError(f"all pairs of {n} nodes asked for; the limit is {max_nodes}")
    # A range join on the smaller end: each source is paired with later nodes only.
    a = nodes.select(F.col("id").alias("src"))
    b = nodes.select(F.col("id").alias("trg"))
    return a.join(b, F.col("src") < F.col("trg")).join(edges.select("src", "trg"), ["src", "trg"], "left_anti")


def block_matrix(sym: DataFrame, membership: DataFrame) -> DataFrame:
    """(ga, gb, w): edge ends between blocks, for membership (node, g)."""
    one = sym.join(membership.select(F.col("node").alias("u"), F.col("g").alias("ga")), "u")
    return one.join(membership.select(F.col("node").alias("v"), F.col("g").alias("gb")), "v").groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("w"))


def sbm_sample(sym: DataFrame, membership: DataFrame, size: int, window: int = 10, degree_corrected: bool = True, seed: int = 0) -> DataFrame:
    """(draw, src, trg): pairs from a stochastic block model of the graph.

    The source is drawn by degree (or uniformly); its block steps by the mean of the block transition
    matrix's powers 1..window (blocks squared numbers, on the driver); the target is drawn in the
    block it gets to. One block and one step is the configuration model, or Erdos-Renyi.
    """
    import numpy as np

    spark = sym.sparkSession
    blocks = block_matrix(sym, membership).collect()
    names = sorted({r["ga"] for r in blocks} | {r["gb"] for r in blocks})
    at = {g: i for i, g in enumerate(names)}
    step = np.zeros((len(names),) * 2)
    for r in blocks:
        step[at[r["ga"]], at[r["gb"]]] = r["w"]
    step /= np.maximum(step.sum(axis=1, keepdims=True), 1e-32)
    power, mean = np.eye(len(names)), np.zeros_like(step)
    for _ in range(window):
        power = power @ step
        mean += power / window
    cum = np.cumsum(mean, axis=1)
    cum[:, -1] = 1.0
    moves = spark.createDataFrame([(g, [float(x) for x in cum[at[g]]]) for g in names], "ga long, cum array<double>")
    deg = degrees(sym).select(F.col("u").alias("node"), "k")
    nodes = membership.join(deg, "node", "left").select("node", "g", F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)).alias("k"))
    one = F.explode(F.sequence(F.lit(1), F.when(F.lit(degree_corrected), F.col("k")).otherwise(F.lit(1)).cast("int")))
    ends = materialise(nodes.select("node", "g", one.alias("r")), "sbm-stubs")
    ranked = global_rank(ends, ["g", "node", "r"], "i")
    size_of = ranked.groupBy("g").agg(F.min("i").alias("lo"), F.count(F.lit(1)).alias("n"))
    sources = sample_nodes(ranked.select("i", "node"), size, seed).join(membership.select("node", F.col("g").alias("ga")), "node")
    u = (second_end(F.col("draw"), seed) % 1000003) / F.lit(1000003.0)
    target = sources.join(F.broadcast(moves), "ga").withColumn("j", F.size(F.filter("cum", lambda c: c < u)))
    chosen = F.get(F.array(*[F.lit(g).cast("long") for g in names]), F.col("j"))
    target = target.select("draw", F.col("node").alias("src"), chosen.alias("g")).join(size_of, "g")
    target = target.withColumn("i", F.col("lo") + first_end(F.col("draw") + 7919, seed) % F.col("n"))
    return target.join(ranked.select("i", F.col("node").alias("trg")), "i").select("draw", "src", "trg")


def labelled_pairs(labels: DataFrame, size: int, seed: int = 0, block: DataFrame | None = None) -> DataFrame:
    """(draw, anchor, positive, negative): the positive shares the anchor's label; the negative has
    another one (and the same block if ``block`` (node, b) is given)."""
    nodes = global_rank(labels, ["node"], "i")
    anchors = sample_nodes(nodes.select("i", "node"), size, seed).join(labels, "node").select("draw", F.col("node").alias("anchor"), "label")
    per = global_rank(labels, ["label", "node"], "i")
    spans = per.groupBy("label").agg(F.min("i").alias("lo"), F.count(F.lit(1)).alias("n"))
    pos = anchors.join(spans, "label").withColumn("i", F.col("lo") + second_end(F.col("draw"), seed) % F.col("n"))
    pos = pos.join(per.select("i", F.col("node").alias("positive")), "i").select("draw", "anchor", "label", "positive")
    pool = labels if block is None else labels.join(block, "node")
    if block is None:
        pool = pool.withColumn("b", F.lit(0))
        pos = pos.withColumn("b", F.lit(0))
    else:
        pos = pos.join(block.select(F.col("node").alias("anchor"), "b"), "anchor")
    order = global_rank(pool, ["b", "label", "node"], "i")
    all_b = order.groupBy("b").agg(F.min("i").alias("blo"), F.count(F.lit(1)).alias("bn"))
    own = order.groupBy("b", "label").agg(F.min("i").alias("olo"), F.count(F.lit(1)).alias("on"))
    neg = pos.join(all_b, "b").join(own, ["b", "label"]).where("bn > on")
    # Skip over the anchor's own label: places behind it move up by its size.
    j = F.col("blo") + first_end(F.col("draw") + 104729, seed) % (F.col("bn") - F.col("on"))
    neg = neg.withColumn("i", F.when(j >= F.col("olo"), j + F.col("on")).otherwise(j))
    return neg.join(order.select("i", F.col("node").alias("negative")), "i").select("draw", "anchor", "positive", "negative")


def sample_with_replacement(rows: DataFrame, order: list[str], size: int, seed: int = 0) -> DataFrame:
    ranked = global_rank(rows, order, "i")
    m = ranked.count()
    draws = rows.sparkSession.range(size).select(F.col("id").alias("draw"), (first_end(F.col("id"), seed) % F.lit(max(m, 1))).alias("i"))
    return draws.join(ranked, "i").drop("i")


def group_sample(rows: DataFrame, group: str, key: Column, size: int) -> DataFrame:
    """At most ``size`` rows of each group, in order of an integer key."""
    w = Window.partitionBy(group).orderBy(key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r")


def negative_context(walk_counts: DataFrame, exponent: float = 0.75, scale: int = 1000) -> DataFrame:
    """Stub list (i, node) in proportion to count ** exponent, for skip-gram negatives."""
    w = F.greatest(F.round(F.pow(F.col("n").cast("double"), F.lit(exponent)) * scale / 100), F.lit(1)).cast("long")
    return membership_stubs(walk_counts.select("node", w.alias("w")), "w")


def undirected(pairs: DataFrame) -> DataFrame:
    return canonical_edges(pairs)


def both_directions(target: DataFrame) -> DataFrame:
    """Target rows and their reversals."""
    return target.unionByName(target.select(F.col("trg").alias("src"), F.col("src").alias("trg"), *[c for c in target.columns if c not in ("src", "trg")]))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("F", "Window", "Column", "DataFrame", "symmetric")]
