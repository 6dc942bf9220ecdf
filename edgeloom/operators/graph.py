"""Graph core: edge tables, degrees, wedges, triangles, breadth-first levels, forests.

An edge table has (src, trg) with src <= trg, distinct; ``symmetric`` turns it into (u, v) with both
directions. A hub makes a wedge join long on its key: such joins run on exchanges that Spark can
split at run time, and wedges are aggregated before they are joined again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.operators import around, folds
from edgeloom.operators.components import star_components
from edgeloom.storage import Table, materialise, settled, shuffle_width


def canonical_edges(pairs: DataFrame) -> DataFrame:
    a, b = pairs.columns[:2]
    return pairs.select(F.least(a, b).cast("long").alias("src"), F.greatest(a, b).cast("long").alias("trg")).distinct()


def weighted_edges(triples: DataFrame, least: float = 0.0) -> DataFrame:
    """(r, c, v) entries summed by key; entries under ``least`` go."""
    a, b, w = triples.columns[:3]
    return triples.groupBy(F.col(a).alias("r"), F.col(b).alias("c")).agg(F.sum(w).alias("v")).where(F.col("v") >= least)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions; a self-loop stays one entry."""
    back = edges.where("src <> trg").select(F.col("trg").alias("u"), F.col("src").alias("v"))
    return edges.select(F.col("src").alias("u"), F.col("trg").alias("v")).unionAll(back)


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> trg")


def upper_triangle(sym: DataFrame, strict: bool = False) -> DataFrame:
    return sym.where("u < v" if strict else "u <= v").select(F.col("u").alias("src"), F.col("v").alias("trg"))


def degrees(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.count(F.lit(1)).alias("k"))


def degree_distribution(deg: DataFrame) -> DataFrame:
    return deg.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def global_rank(rows: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 0 by ``order``: range partitions are sorted and numbered in place, and each
    gets the number of rows before it (as many numbers as partitions)."""
    n = shuffle_width(rows.sparkSession)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(at)
        at += counts.get(p, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in before or [0]]), part.cast("int"))
    return dealt.withColumn(name, start + within).drop("__m")


def reindex(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over ids 0..n-1 in order of the old ids, and the dictionary (id, old)."""
    nodes = edges.select(F.col("src").alias("old")).union(edges.select("trg")).distinct()
    names = global_rank(nodes, ["old"], "id").select("id", "old")
    one = edges.join(names.select(F.col("old").alias("src"), F.col("id").alias("a")), "src")
    two = one.join(names.select(F.col("old").alias("trg"), F.col("id").alias("b")), "trg")
    return canonical_edges(two.select("a", "b")), names


def components(edges: DataFrame) -> DataFrame:
    return star_components(edges.select("src", "trg"))


def giant_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component (of equal ones, that with the smallest node)."""
    comps = materialise(components(edges), "components")
    best = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = comps.join(F.broadcast(best), "component").select(F.col("node").alias("src"))  # one row is broadcast
    return edges.join(inside, "src", "left_semi")


def neighbour_sums(sym: DataFrame, middle: DataFrame | None = None) -> DataFrame:
    """A times A: (u, v, paths) over pairs with a shared neighbour; ``middle`` (u, w) weighs the neighbour."""
    left = sym.select(F.col("u").alias("a"), F.col("v").alias("z"))
    if middle is not None:
        left = left.join(middle.select(F.col("u").alias("z"), "w"), "z")
    weight = F.count(F.lit(1)) if middle is None else F.sum("w")
    right = sym.select(F.col("u").alias("z"), F.col("v").alias("b"))
    return left.join(right, "z").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(weight.alias("paths"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c: wedges at the lowest-degree end closed by an edge."""
    sym = symmetric(drop_self_loops(edges))
    deg = degrees(sym)
    ends = drop_self_loops(edges).join(deg.select(F.col("u").alias("src"), F.col("k").alias("ks")), "src").join(deg.select(F.col("u").alias("trg"), F.col("k").alias("kt")), "trg")
    up = (F.col("ks") < F.col("kt")) | ((F.col("ks") == F.col("kt")) & (F.col("src") < F.col("trg")))
    # Out-degrees of this orientation are at most the root of twice the edges, hubs included.
    out = ends.select(F.when(up, F.col("src")).otherwise(F.col("trg")).alias("x"), F.when(up, F.col("trg")).otherwise(F.col("src")).alias("y"))
    wedge = out.join(out.withColumnRenamed("y", "z"), "x").where("y < z")
    shut = wedge.join(edges.select(F.col("src").alias("y"), F.col("trg").alias("z")), ["y", "z"], "left_semi")
    s = F.array_sort(F.array("x", "y", "z"))
    return shut.select(F.get(s, F.lit(0)).alias("a"), F.get(s, F.lit(1)).alias("b"), F.get(s, F.lit(2)).alias("c"))


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(u, t): triangles at each node that has any."""
    return triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("t"))


def bfs_levels(sym: DataFrame, roots: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(node, level) of everything reachable from ``roots`` (node). One join a level, written each time."""
    sym = materialise(sym, "bfs-graph")
    seen = Table(roots.select("node", F.lit(0).alias("level")), "bfs")
    front, depth = seen.df, 0
    found = [seen.df]
    while depth < max_depth:
        depth += 1
        step = sym.join(front.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct()
        # Neighbours of a level are on it, next to it or new.
        for known in found[-2:]:
            step = step.join(known.select("node"), "node", "left_anti")
        nxt = Table(step.withColumn("level", F.lit(depth)), "bfs")
        if nxt.df.isEmpty():
            nxt.drop()
            break
        found.append(nxt.df)
        front = nxt.df
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Tree edges of a breadth-first forest from each component's smallest node.

    A node's parent is its smallest neighbour one level up, so the forest is unique. It is searched in
    tasks that hold the nodes' levels (``folds``); on a graph too large for that, by joins.
    """
    plain = drop_self_loops(materialise(edges, "forest-edges"))
    found = folds.forest(plain)
    if found is not None:
        return canonical_edges(folds.in_forest(plain.select("src", "trg"), found, True))
    roots = settled(lambda: components(plain).select(F.col("component").alias("node")).distinct(), "forest-roots")
    levels = settled(lambda: bfs_levels(symmetric(plain), roots), "forest-levels")
    # An edge is met once, not from both sides: its ends' levels tell which of them is the child.
    ends = plain.join(levels.select(F.col("node").alias("src"), F.col("level").alias("ls")), "src").join(levels.select(F.col("node").alias("trg"), F.col("level").alias("lt")), "trg").where("ls <> lt")
    down = F.col("ls") < F.col("lt")
    up = ends.select(F.when(down, F.col("trg")).otherwise(F.col("src")).alias("u"), F.when(down, F.col("src")).otherwise(F.col("trg")).alias("v"))
    tree = up.groupBy("u").agg(F.min("v").alias("p"))
    return canonical_edges(tree.select("u", "p"))


def _held_distances(shared, want: DataFrame, most: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, trg = (b.column(c).to_numpy() for c in ("src", "trg"))
            d = around.hops(shared.value, *(shared.value.number(x) for x in (src, trg)), most)
            d = np.where(src == trg, 0, d).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d, mask=d < 0)], ["src", "trg", "hops"])

    return want.mapInArrow(run, "src long, trg long, hops int")


def hop_distances(sym: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(src, trg, hops) of each pair, null if no path joins them or, with ``most``, none of so many hops.

    Tasks that hold the graph search from both ends of a pair. On a graph too large for that only the
    pairs' sources expand, by joins, each until its pairs are met or nothing new is reached.
    """
    shared = around.held(sym)
    if shared is not None:
        return _held_distances(shared, pairs.select(F.col("src").cast("long"), F.col("trg").cast("long")).distinct(), most)
    want = materialise(pairs.select("src", "trg").distinct(), "hop-pairs")
    sym = materialise(sym, "hop-graph")
    front = materialise(want.select(F.col("src").alias("s"), F.col("src").alias("node")).distinct(), "hops")
    met = want.where("src = trg").withColumn("hops", F.lit(0))
    left = materialise(want.where("src <> trg"), "hop-left")
    before, d = None, 0
    while (most is None or d < most) and not left.isEmpty():
        d += 1
        step = front.join(left.select(F.col("src").alias("s")).distinct(), "s", "left_semi").join(sym.select(F.col("u").alias("node"), "v"), "node").select("s", F.col("v").alias("node")).distinct()
        # Neighbours of a level are on it, next to it or new.
        for known in (front, before):
            step = step if known is None else step.join(known, ["s", "node"], "left_anti")
        before, front = front, materialise(step, "hops")
        if front.isEmpty():
            break
        hit = materialise(left.join(front.select(F.col("s").alias("src"), F.col("node").alias("trg")), ["src", "trg"], "left_semi"), "hop-met")
        met = met.union(hit.withColumn("hops", F.lit(d)))
        left = materialise(left.join(hit, ["src", "trg"], "left_anti"), "hop-left")
    return want.join(met, ["src", "trg"], "left")


def row_normalise(entries: DataFrame, least: float = 1e-32) -> DataFrame:
    """(u, v, p): entries (u, v, w) over their row's sum."""
    total = F.sum("w").over(Window.partitionBy("u"))
    return entries.select("u", "v", (F.col("w") / F.greatest(total, F.lit(least))).alias("p"))


def running_probability(p: DataFrame) -> DataFrame:
    """(u, v, p, cum): running sums in each row; the last is 1 exactly."""
    w = Window.partitionBy("u").orderBy("v")
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy("u"))
    total = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return p.select("u", "v", "p", F.when(last, F.lit(1.0)).otherwise(total).alias("cum"))


def roulette_pick(cum: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, u, v): for each (draw, u, r) the first v of row u whose running probability reaches r."""
    hit = draws.join(cum.select("u", "v", "cum"), "u").where("cum >= r")
    return hit.groupBy("draw", "u").agg(F.min_by("v", "cum").alias("v"))


def mask_edges(scores: DataFrame, sym: DataFrame) -> DataFrame:
    """Scores (u, v, ...) of pairs that are no edge; self pairs stay unless they are loops."""
    return scores.join(sym.select("u", "v"), ["u", "v"], "left_anti")
