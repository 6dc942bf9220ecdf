"""Mixing sources to target weights by the cube method.

A document's expected number of copies is its source's target over its source's size; the whole part
is taken for sure, the fraction is an inclusion probability. Probabilities are moved in the null
space of the constraints - sum of tokens and number of documents of the source - until each is 0 or
1 (flight), the largest documents first, so that what is left to land is small. A flight runs over blocks of a source's documents, in parallel, and leaves at most two
fractions a block; those of many blocks meet in the next round's blocks, until one block a source is
left, whose last fractions are rounded to keep both sums nearest (landing). A source with a third of all documents
is simply many blocks.

Draws come from hashes of doc_id and seed, so reruns agree. Texts never travel.

Defined results: null text has size 0; null sources are one source, the last; empty tables give
empty results; repeated rows are documents of their own, told apart by a number within equal rows;
a text of any length is counted whole and is one document; documents of equal size fly in the order of
their hashes; other columns are kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.common import WORD, spare_prefix
from edgeloom.operators.graph import global_rank
from edgeloom.storage import materialise

_EPS = 1e-9


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """source, source_size, target from a table of (source, source_size), one row a source.

    Sources in order of code points, null last, get ``weights`` in turn and share the sum of sizes;
    no target is above ``cap`` times its size, and what is cut is shared by weight among the others.
    That is min(cap * size, level * weight) for the one level at which targets add up: sources by
    rising cap/weight are cut first.
    """
    k = len(weights)
    given = F.array(*[F.lit(float(x)) for x in weights])
    ranked = global_rank(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "nth_source")
    weight = F.element_at(given, (F.pmod(F.col("nth_source"), F.lit(k)) + 1).cast("int")).alias("w")
    t = materialise(ranked.select("source", "source_size", weight, (F.lit(float(cap)) * F.col("source_size")).alias("most")), "mix-weights")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    # Sources above the level are cut, what they leave raises it for the others; it only rises, so this ends.
    level, cut = 0.0, -1
    while True:
        is_cut = F.col("most") <= F.lit(level) * F.col("w")
        got = t.agg(F.count_if(is_cut).alias("n"), F.sum(F.when(is_cut, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(is_cut, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if got["n"] == cut or not got["w"]:
            break
        cut, level = got["n"], (total - got["taken"]) / got["w"]
    return t.select("source", "source_size", F.least(F.col("most"), F.lit(float(level)) * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase with constraints sum(p) and sum(p * size).

    The first document that is still open moves against all other open ones, along the direction that
    changes neither sum, to where the first of them gets 0 or 1; the side is drawn so that expectations
    stay. Given in falling size, the largest settle while many small ones can make up for them. At most two
    fractions remain.
    """
    p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    for u in draws[open_].tolist():
        if len(open_) < 3:
            break
        x, s = p[open_], size[open_]
        v = np.empty(len(open_))
        v[0] = 1.0
        q = x[1:] * (1 - x[1:])
        mean = float(q @ s[1:]) / float(q.sum())
        off = s[1:] - mean
        spread = float(q @ (off * off))
        if spread > 1e-9 * max(mean * mean, 1.0):
            v[1:] = -q * (1 / float(q.sum()) + off * ((s[0] - mean) / spread))
        elif abs(s[0] - mean) < 1e-9 * max(mean, 1.0):
            v[1:] = -q / float(q.sum())
        else:  # all others are of one size: two of them trade
            v[:] = 0.0
            v[1], v[2] = 1.0, -1.0
        moves = np.abs(v) > 1e-15
        with np.errstate(divide="ignore", invalid="ignore"):
            up = float(np.where(v > 0, (1 - x) / v, -x / v)[moves].min())
            down = float(np.where(v > 0, x / v, (x - 1) / v)[moves].min())
        x = x + (up if u * (up + down) < down else -down) * v
        p[open_] = x = np.where(x < _EPS, 0.0, np.where(x > 1 - _EPS, 1.0, x))
        open_ = open_[(x > 0) & (x < 1)]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last fractions (two at most after a flight) rounded to whatever keeps both sums nearest.

    Tokens come first, in units of the larger document; documents decide ties.
    """
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    scale = max(float(size[left].max()), 1.0) if len(left) else 1.0
    best = None
    for bits in range(1 << len(left)):
        take = np.array([(bits >> j) & 1 for j in range(len(left))], dtype=float)
        off = take - p[left]
        cost = (abs(float(off @ size[left])) / scale, abs(float(off.sum())), bits)
        if best is None or cost < best[0]:
            best = cost, take
    p[left] = best[1]
    return np.round(p)


def _pass(rows: DataFrame, last: bool) -> DataFrame:
    """One round: every (source, block) flies; the last round lands as well."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "draw", "id", "nth"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        p = flight(block["p"].to_numpy(float), block["size"].to_numpy(float), block["u"].to_numpy(float))
        block["p"] = landing(p, block["size"].to_numpy(float)) if last else p
        return block

    return rows.groupBy("skey", "block").applyInPandas(run, rows.schema)


def mix(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 7, block_rows: int = 4000) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, nth for each row of (doc_id, text, source)."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    base = documents.select("doc_id", "source", skey.alias("skey"), token_count(F.col("text")).alias("size"))
    # Equal rows are numbered; rows that differ in nothing are interchangeable.
    grouped = base.groupBy("doc_id", "source", "skey", "size").agg(F.count(F.lit(1)).alias("__n"))
    base = materialise(grouped.select("doc_id", "source", "skey", "size", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("nth")), "mix-sizes")
    per = materialise(base.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    aims = targets(per.select("source", "source_size"), weights, cap).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"), "source_size", "target")
    aims = materialise(aims.join(per.select("skey", "n"), "skey"), "mix-targets")
    # A source may have a third of all documents: its one row comes in salted copies.
    salts = 32
    dealt = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    full = dealt.join(aims.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), ["skey", "salt"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    hashed = lambda tag: F.pmod(F.xxhash64("doc_id", "nth", "size", F.lit(f"{tag} {seed}")), F.lit(1 << 52))
    rows = full.select("doc_id", "source", "skey", "size", "nth", "source_size", "target", F.floor(rate + 1e-12).cast("long").alias("whole"), rate.alias("rate"), "n")
    rows = rows.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    move = rows.where("p > 0").select(
        F.col("doc_id").alias("id"), "nth", "skey", "size", "p", hashed("order").alias("draw"), (hashed("draw") / F.lit(float(1 << 52))).alias("u"),
        F.pmod(F.xxhash64("doc_id", "nth", F.lit(f"block {seed}")), F.ceil(F.col("n") / block_rows).cast("long")).alias("block"),
    )
    most = per.agg(F.max("n")).first()[0] or 0
    done = None
    blocks = max(1, -(-most // block_rows))
    while True:
        final = blocks == 1
        flown = materialise(_pass(move, final), "mix-flight")
        settled = flown if final else flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        if final:
            break
        # Two fractions a block are left; this many blocks' worth fill the next one.
        merge = block_rows // 2
        move = flown.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / merge))
        blocks = -(-blocks // merge)
    drawn = done.where("p = 1").select(F.col("id").alias("doc_id"), "nth", "skey", "size", F.lit(1).alias("one"))
    out = rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = drawn.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), "nth", "skey", "size", "one")
    out = out.join(drawn, ["__id", "nth", "skey", "size"], "left")
    return out.select("doc_id", "source", "skey", "size", "source_size", "target", (F.col("whole") + F.coalesce("one", F.lit(0))).alias("copies"), "nth")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``documents``, each as often as the mix takes it."""
    plan = mix(documents, **options)
    # Rows with equal ids, sources and sizes share their copies in any order: number them on both sides.
    pre = spare_prefix(documents.columns)
    id_, skey, size, nth, t, copies, copy = (f"{pre}{x}" for x in ("id", "skey", "size", "nth", "text", "copies", "copy"))
    named = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias(id_)
    rows = documents.select("*", named(F.col("doc_id")), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias(skey), token_count(F.col("text")).alias(size), F.xxhash64("text").alias(t))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(id_, skey, size).orderBy(t)))
    plan = plan.where("copies > 0").select(named(F.col("doc_id")), F.col("skey").alias(skey), F.col("size").alias(size), F.col("nth").alias(nth), F.col("copies").alias(copies))
    out = rows.join(plan, [id_, skey, size, nth])
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*documents.columns)
