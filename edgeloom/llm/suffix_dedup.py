"""Removal of repeated byte strings by common-prefix intervals of an enhanced suffix array.

A suffix array over the whole corpus would be many times its size, so suffixes are first dealt to where
all that share ``length`` bytes must meet, and only those that can:

1. Every document is cut into pieces (see ``anchors``), each named by its anchor's and its content's
   64-bit hashes. Within an Arrow batch a piece that came earlier is marked at once.
2. Pieces are dealt by anchor. Of pieces with equal hashes all but the first repeat it whole. The first
   ones of an anchor that has several contents may share some windows: these pieces are asked for.
3. The asked pieces' bytes are dealt by anchor. Each task sorts its windows into a suffix array cut off
   at ``length`` bytes, scans the array of common prefixes with a stack for intervals of at least
   ``length``, and gets each group of equal strings with all its occurrences; whether a group can be
   extended to the left (all occurrences have one byte before) tells maximal repeats from inner ones.
   All but a group's first occurrence are repeats. An anchor with very many asked pieces is dealt by the
   window's own hash instead, and its groups by aggregation.
4. Each document drops the bytes that repeated windows cover.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; a null doc_id comes
before all others; rows of one doc_id are ordered by text, and equal rows are one document whose
result each of them gets; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.anchors import Strings, pieces
from edgeloom.llm.common import small_batches
from edgeloom.storage import materialise

_LEAST_ID = -(1 << 63)
#: Windows that a task sorts at once; an anchor's windows beyond that are dealt by their hashes.
WINDOWS = 1 << 17


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix array of a byte string by prefix doubling."""
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        same = (rank[order[1:]] == rank[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(~same)])
        rank = new
        step *= 2
        if rank.max() == n - 1 or step >= n:
            break
    return order


def common_prefixes(data: bytes, order: np.ndarray) -> np.ndarray:
    """lcp[i]: bytes that the suffixes at places i - 1 and i of the array share; lcp[0] = 0."""
    n = len(order)
    place, lcp, h = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
    place[order] = np.arange(n)
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and data[i + h] == data[j + h]:
                h += 1
            lcp[place[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return lcp


def prefix_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The nodes (depth, first, last) of the common-prefix interval tree with depth >= least.

    One scan with a stack over the runs of equal values.
    """
    out: list[tuple[int, int, int]] = []
    if len(lcp) < 2:
        return out
    value = np.where(lcp >= least, lcp, 0)
    value[0] = 0
    edge = np.flatnonzero(np.diff(value)) + 1
    begins = np.concatenate([[0], edge])
    stack: list[tuple[int, int]] = []
    for v, at in zip([*value[begins].tolist(), 0], [*begins.tolist(), len(lcp)]):
        left = at - 1
        while stack and stack[-1][0] > v:
            depth, left = stack.pop()
            out.append((depth, left, at - 1))
        if v and (not stack or stack[-1][0] < v):
            stack.append((v, left))
    return out


def maximal_repeats(data: bytes, least: int) -> list[tuple[int, list[int]]]:
    """(length, all starts) of every repeat that cannot be extended to either side in all occurrences."""
    order = suffix_array(data)
    found = []
    for depth, a, b in prefix_intervals(common_prefixes(data, order), least):
        starts = order[a : b + 1]
        if (starts == 0).any() or len({data[s - 1] for s in starts}) > 1:
            found.append((int(depth), sorted(int(s) for s in starts)))
    return sorted(found)


def _cut(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, content, doc, nth, start, windows, again) of every piece; ``again``: not its batch's first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(["doc", "nth"], kind="stable")
            coded = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            held, size, at = [], 0, 0
            parts = []
            for i, b in enumerate(coded):
                held.append(b)
                size += len(b)
                if size > 1 << 19 or i == len(coded) - 1:
                    raw, ends = np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])
                    start, windows, anchor, content = pieces(raw, ends, length, k)
                    doc = np.searchsorted(ends, start, side="right")
                    parts.append(pd.DataFrame({"anchor": anchor, "content": content, "doc": batch["doc"].to_numpy()[at + doc], "nth": batch["nth"].to_numpy()[at + doc], "start": start - np.concatenate([[0], ends])[doc], "windows": windows.astype(np.int32)}))
                    held, size, at = [], 0, i + 1
            if parts:
                out = pd.concat(parts, ignore_index=True)
                out["again"] = out.duplicated(["anchor", "content"])
                yield out

    return rows.mapInPandas(run, "anchor long, content long, doc long, nth int, start long, windows int, again boolean")


def _piece_bytes(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, nth, start, windows, piece, before) of the pieces that a document is asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, nth, text, asked in zip(b["doc"], b["nth"], b["text"], b["asked"]):
                raw = text.encode("utf-8", "surrogatepass")
                for q in asked:
                    s = q["start"]
                    out.append((q["anchor"], doc, nth, s, q["windows"], raw[s : s + q["windows"] + length - 1], raw[s - 1] if s else -1))
            yield pd.DataFrame(out, columns=["anchor", "doc", "nth", "start", "windows", "piece", "before"])

    return rows.mapInPandas(run, "anchor long, doc long, nth int, start long, windows int, piece binary, before int")


def _groups(raw: np.ndarray, at: np.ndarray, key: np.ndarray, length: int) -> list[tuple[np.ndarray, bool]]:
    """Groups of equal windows of ``raw`` at places ``at``: their indexes into ``at``, in order of ``key``,
    and whether the bytes before them differ. ``raw`` has a byte before each place."""
    hashes = Strings(raw).hashes(at, at + length)
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    near = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    kept = order[near]  # a window whose hash no other has is in no interval
    if not len(kept):
        return []
    # Equal windows have equal hashes, so the suffix array may be made for some hashes at a time.
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    hashes, found, lo = hashes[kept], [], 0
    while lo < len(kept):
        last = hashes[min(lo + WINDOWS, len(kept)) - 1]
        hi = lo + int(np.searchsorted(hashes[lo:], last, "right"))
        found += _sorted_groups(raw, padded, at, key, kept[lo:hi], length)
        lo = hi
    return found


def _sorted_groups(raw: np.ndarray, padded: np.ndarray, at: np.ndarray, key: np.ndarray, kept: np.ndarray, length: int) -> list[tuple[np.ndarray, bool]]:
    # The suffix array cut off at `length` bytes: big-endian words sort as the bytes do.
    wide = -(-length // 8) * 8
    view = np.lib.stride_tricks.sliding_window_view(padded, wide)[at[kept]]
    view[:, length:] = 0
    words = view.view(">u8")
    order = np.lexsort([key[kept], *[words[:, j] for j in range(words.shape[1] - 1, -1, -1)]])
    words, kept = words[order], kept[order]
    differ = words[1:] != words[:-1]
    # Common prefixes up to `length`: whole words, and anything less is below the least depth.
    lcp = np.concatenate([[0], np.where(differ.any(axis=1), 8 * differ.argmax(axis=1), length)])
    before = raw[at[kept] - 1]
    return [(kept[a : b + 1], bool((before[a : b + 1] != before[a]).any())) for _, a, b in prefix_intervals(lcp, length)]


def _repeats(rows: DataFrame, length: int) -> DataFrame:
    """(doc, nth, start, windows): runs of windows that are not their group's first, by anchor's task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(b: pd.DataFrame) -> pd.DataFrame:
            size = b["piece"].str.len().to_numpy(dtype=np.int64)
            lead = np.cumsum(size + 1) - size  # each piece behind one byte of its own
            raw = np.zeros(int((size + 1).sum()) + length, np.uint8)
            flat = np.frombuffer(b"".join(b"\0" + p for p in b["piece"]), np.uint8)
            raw[: len(flat)] = flat
            raw[lead - 1] = np.maximum(b["before"].to_numpy(), 0)
            n = b["windows"].to_numpy(dtype=np.int64)
            piece = np.repeat(np.arange(len(b)), n)
            rel = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            # Rows are in order of document and start, so a window's number is its order.
            again = np.zeros(len(piece), dtype=bool)
            for members, _ in _groups(raw, lead[piece] + rel, np.arange(len(piece)), length):
                again[members[1:]] = True
            edge = again & ~(np.concatenate([[False], again[:-1]]) & (rel > 0))
            first = np.flatnonzero(edge)
            count = np.add.reduceat(again, first) if len(first) else np.zeros(0, dtype=np.int64)
            # reduceat sums up to the next run's start; only marked windows count, and a run has no gap.
            p = piece[first]
            return pd.DataFrame({"doc": b["doc"].to_numpy()[p], "nth": b["nth"].to_numpy()[p], "start": b["start"].to_numpy()[p] + rel[first], "windows": count.astype(np.int32)})

        # Rows come sorted by anchor: whole anchors are worked on together, some at a time.
        held: pd.DataFrame | None = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            whole = held["anchor"].to_numpy() != held["anchor"].iloc[-1]
            if held["windows"].to_numpy()[whole].sum() >= WINDOWS:
                ready = held[whole].sort_values(["doc", "nth", "start"], kind="stable").reset_index(drop=True)
                held = held[~whole].reset_index(drop=True)
                yield solve(ready)
        if held is not None and len(held):
            yield solve(held.sort_values(["doc", "nth", "start"], kind="stable").reset_index(drop=True))

    return rows.mapInPandas(run, "doc long, nth int, start long, windows int")


def _by_window(rows: DataFrame, length: int) -> DataFrame:
    """The same for pieces of anchors that have very many: windows dealt by their own 128-bit hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for i in range(0, len(batch), 2000):
                b = batch.iloc[i : i + 2000]
                out = [(xxhash.xxh3_128_digest(p[j : j + length]), d, m, s + j) for p, d, m, s, w in zip(b["piece"], b["doc"], b["nth"], b["start"], b["windows"]) for j in range(w)]
                yield pd.DataFrame(out, columns=["key", "doc", "nth", "start"])

    each = materialise(rows.mapInPandas(run, "key binary, doc long, nth int, start long"), "suffix-windows")
    first = each.groupBy("key").agg(F.min(F.struct("doc", "nth", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "f")
    # Every window that is some group's first stays; the join back is by window, salted for hot ones.
    salts = 16
    left = each.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(salts)).cast("int"))
    right = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = left.join(right, ["key", "salt"]).where(F.struct("doc", "nth", "start") != F.col("f"))
    return hit.select("doc", "nth", "start", F.lit(1).alias("windows"))


def _drop(rows: DataFrame, length: int) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept bytes of every document with its repeated windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, nth, text, found in zip(b["doc"], b["nth"], b["text"], b["found"]):
                raw = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for s, n in sorted((q["start"], q["windows"]) for q in found) if found is not None else ():
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s + n + length - 1)
                    else:
                        spans.append([s, s + n + length - 1])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, nth, len(raw), len(raw) - len(left), len(spans), left))
            yield pd.DataFrame(out, columns=["doc", "nth", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInPandas(run, "doc long, nth int, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(documents: DataFrame, length: int = 100, k: int = 24, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row of (doc_id, text).

    ``hot``: an anchor with more asked pieces than this is worked on by window.
    """
    small_batches(documents.sparkSession)
    base = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    many = base.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    if many:
        alone = base.groupBy("doc", "text").agg(F.count(F.lit(1)).alias("times"))
        rows = alone.withColumn("nth", (F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1).cast("int"))
        rows = materialise(rows.select("doc", "nth", "text", "times"), "suffix-rows")
    else:
        rows = base.select("doc", F.lit(0).alias("nth"), "text", F.lit(1).cast("long").alias("times"))
    texts = rows.select("doc", "nth", "text")

    cut = _cut(texts, length, k)
    # What its batch already knows to be a repeat needs no partner: it is dealt by itself.
    dealt = cut.withColumn("deal", F.when(F.col("again"), F.xxhash64("doc", "start")).otherwise(F.col("anchor")))
    same = Window.partitionBy("deal", "again", "anchor", "content").orderBy("doc", "nth", "start")
    group = Window.partitionBy("deal", "again", "anchor")
    seen = dealt.withColumn("r", F.row_number().over(same))
    seen = seen.withColumn("mixed", (F.min("content").over(group) != F.max("content").over(group)))
    kind = F.when(F.col("again") | (F.col("r") > 1), 1).when(F.col("mixed"), 2)
    known = seen.select("anchor", "doc", "nth", "start", "windows", kind.alias("kind")).where("kind is not null")
    known = materialise(known, "suffix-pieces")

    asked = known.where("kind = 2").groupBy("doc", "nth").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("asked"))
    given = materialise(_piece_bytes(texts.join(asked.hint("merge"), ["doc", "nth"]).select("doc", "nth", "text", "asked"), length), "suffix-bytes")
    busy = materialise(given.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor"), "suffix-busy")
    some = not busy.isEmpty()
    calm = given.join(busy, "anchor", "left_anti") if some else given
    found = _repeats(calm.repartition("anchor").sortWithinPartitions("anchor", "doc", "nth", "start"), length)
    if some:
        found = found.union(_by_window(given.join(busy, "anchor", "left_semi"), length))
    found = found.union(known.where("kind = 1").select("doc", "nth", "start", "windows"))
    per = found.groupBy("doc", "nth").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    # Both joins with the texts shuffle at every size, so that a plan's cost follows its input.
    out = _drop(texts.join(per.hint("merge"), ["doc", "nth"], "left").select("doc", "nth", "text", "found"), length)
    if many:
        out = out.join(rows.select("doc", "nth", "times"), ["doc", "nth"]).withColumn("__t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    doc_id = F.when(F.col("doc") != _LEAST_ID, F.col("doc")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept")
