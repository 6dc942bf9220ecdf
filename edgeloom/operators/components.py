"""Connected components by alternating large-star and small-star.

State is an edge table (u, v). Large-star links every larger neighbour of a node to the smallest
node of its neighbourhood; small-star links the smaller neighbours. Both are a grouped minimum and
a join back, so nothing collects a neighbourhood; the edges end as one star per component. The
number of rounds is logarithmic in practice. Every round is written to the shared folder. With ``local``
each task first turns the edges it has into a forest of stars, as a combiner: a graph whose edges fit
into one task is done by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import Table, materialise, width_for


def _star(edges: DataFrame, large: bool, width: int) -> DataFrame:
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The minima are written first: then both join sides end in plain exchanges and Spark can split a
    # hub's partition at run time (a hub's row exists once on the minimum side).
    least = materialise(around.groupBy("u").agg(F.min("v").alias("__m")), "star-min", width).withColumnRenamed("u", "__k")
    joined = around.join(least, around["u"] == least["__k"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.least("__m", "u").alias("v"))
    else:
        moved = joined.where("v <> __m").select(F.col("v").alias("u"), F.col("__m").alias("v"))
        out = moved.union(least.select(F.col("__k").alias("u"), F.col("__m").alias("v")))
    return out.distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node either points to one node or is pointed to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low")).union(edges.select("v", F.lit(0)))
    per = ends.groupBy("node").agg(F.sum("low").alias("points"), F.min("low").alias("low"))
    return per.where("points > 1 or (points > 0 and low = 0)").isEmpty()


def _forest(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges (u, v) of longs with the same components: the stars of the edges a task has, ``most`` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def stars() -> pd.DataFrame:
            return pd.DataFrame([(x, find(x)) for x in root if x != find(x)], columns=["u", "v"], dtype="int64")

        for b in batches:
            for u, v in zip(b["u"].tolist(), b["v"].tolist()):
                x, y = find(root.setdefault(u, u)), find(root.setdefault(v, v))
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > most:
                yield stars()
                root.clear()
        yield stars()

    return edges.mapInPandas(run, "u long, v long")


def star_components(edges: DataFrame, local: bool = False) -> DataFrame:
    """(node, component) of every node of an undirected edge table's first two columns.

    ``component`` is the smallest node of the component. A node with a self-loop alone is its own
    component, rows with a null end are ignored, repeated and reversed edges are one edge.
    """
    a, b = edges.columns[:2]
    raw = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    state = Table(raw.distinct(), "star")
    width = width_for(edges.sparkSession, state.df.count())
    loops = state.df.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    links = state.df.where("u <> v")
    # Fewer tasks before the combiner, not after it: a task starts it once and sees all of its edges.
    combined = (lambda df: _forest(df.coalesce(width))) if local else (lambda df: df)
    if local:
        links = Table(combined(links), "star", width).df
    while not _is_done(links):
        step = Table(_star(links, True, width), "star", width)
        state = Table(combined(_star(step.df, False, width)), "star", width)
        step.drop()
        links = state.df
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
