"""Best-fit packing planned on the histogram of lengths.

1. Texts become token ids and pieces of at most ``size`` tokens (Arrow batches).
2. The histogram of piece lengths - at most ``size`` numbers, whatever the input - goes to the driver,
   which runs best-fit decreasing over counts: equal bins are one entry with a count.
3. Every piece gets its rank among pieces of its length: counts by (length, bucket) give each
   bucket's first rank, and a window numbers the pieces within it. Buckets bound the window's groups,
   so a length that a third of all pieces have is spread over many tasks.
4. Pieces take the slots that the plan has for (length, rank): the plan's rows, at most a few a
   length, are joined on length.

Defined results: a null text is empty and a piece of its end mark alone; repeated rows are pieces of
their own; other columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.common import small_batches
from edgeloom.llm.tokens import encoder
from edgeloom.storage import materialise, shuffle_width


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes what doesn't fill a piece."""
    if n <= size:
        return [(0, n)]
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, first if s == 0 and first else size) for s in starts]


def pieces(documents: DataFrame, tokenizer: str, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, mark = encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                raw = encode(text) + mark
                for k, (s, n) in enumerate(cut(len(raw) // 4, size)):
                    rows.append((doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first_rank, n, first_sequence, offset) entries.

    Pieces of one length with ranks first_rank to first_rank + n - 1 go one each to n consecutive
    sequences from first_sequence, at one offset.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: ranges (first, n) of sequences
    out, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = next((r for r in range(length, size + 1) if room[r]), None)
            if fit is None:  # open what identical pieces will fill, all alike, then the rest
                each = size // length
                n = left // each or 1
                room[size].append((made, n))
                made += n
                fit = size
            first, n = room[fit].pop()
            take = min(n, left)
            if take < n:
                room[fit].append((first + take, n - take))
            out.append((length, rank, take, first, size - fit))
            room[fit - length].append((first, take))
            rank, left = rank + take, left - take
    return out


def pack(documents: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, bucket_rows: int = 200_000) -> DataFrame:
    """The pieces of every row with sequence_id and offset."""
    spark = documents.sparkSession
    small_batches(spark)
    cutted = materialise(pieces(documents, tokenizer, size, end), "pieces")
    counts = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, size)
    if not steps:
        return cutted.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    buckets = max(shuffle_width(spark), -(-sum(counts.values()) // bucket_rows))
    rows = cutted.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = rows.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    w = Window.partitionBy("length", "__b").orderBy("doc_id", "piece")
    ranked = rows.join(first, ["length", "__b"]).withColumn("__rank", F.col("__first") + F.row_number().over(w) - 1)
    # At most `size` rows: one a length, with its plan entries in rank order.
    by: dict[int, list] = defaultdict(list)
    for length, rank, _, seq, offset in steps:
        by[length].append((rank, seq, offset))
    rows_of = [(k, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for k, v in by.items()]
    slots = spark.createDataFrame(rows_of, "length long, __ranks array<bigint>, __seqs array<bigint>, __offsets array<bigint>")
    placed = ranked.join(F.broadcast(slots), "length")
    placed = placed.withColumn("__i", F.size(F.filter("__ranks", lambda r: r <= F.col("__rank"))) - 1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.get("__seqs", F.col("__i")) + F.col("__rank") - F.get("__ranks", F.col("__i"))).alias("sequence_id"), F.get("__offsets", F.col("__i")).alias("offset"))
