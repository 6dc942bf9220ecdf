"""Document fingerprints by order MinHash, in DataFrame operations only.

A text's k-mers (k words, split at single blanks) are numbered by occurrence, so a repeated k-mer is
a new element each time. Each of ``rings`` independent hashes orders the elements on a ring of its own; a
sketch's hash order is one of the rings begun at one of evenly spaced points. Each sketch selects the ``tuple_size`` minimal elements in its
order, restores their order in the text and hashes that tuple of k-mers. Equal texts have equal
fingerprints, and moving passages changes tuples although the set of k-mers stays, so the share of
equal sketches follows edit distance rather than overlap.

All of it happens within a row, on arrays: hashes and positions are packed into one long (33 bits of
hash, 31 of position, which is any array's length) and sorted as primitives.

Defined results: a null text is empty; a text without words has the fingerprint of nothing, which
equals only itself; fewer than k words make one k-mer of them all; null ids come first; rows of one doc_id
follow each other by text, repeated rows each have the next of them as their next; the last row's next is
the first; texts of any length are read whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.common import WORD

_POS = 31
_MASK = (1 << _POS) - 1


def _key(x: Column) -> Column:
    return F.shiftright(x, _POS)


def _pack(h: Column, i: Column) -> Column:
    return h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_MASK)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and never leaves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """What k-mers are made of: the parts between single blanks. Plain replacements and a split at one
    character take the engine's fast paths, which a pattern of blanks doesn't."""
    for blank in "\n\t\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def sketch(rows: DataFrame, text: str, out: str, k: int = 5, sketches: int = 128, tuple_size: int = 2, rings: int = 4) -> DataFrame:
    """``rows`` with an array of ``sketches`` longs in column ``out``; both numbers are powers of 2.

    Each intermediate array is a column that the next one mentions more than once: what is mentioned
    once may be inlined, and would be computed again for every element of a lambda.
    """
    n = f"__{out}"
    s, u, r, f, e = (f"{n}_{x}" for x in "surfe")
    keep = rows.columns
    none = F.array().cast("array<bigint>")
    upto = lambda c, extra: F.sequence(F.lit(0), F.size(c) - extra)
    # k-mers with their places, sorted: equal k-mers are runs, in text order.
    mers = lambda w: F.transform(upto(w, k), lambda i: _pack(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i))
    few = lambda w: F.array(_pack(F.xxhash64(w), F.lit(0)))
    whole = F.coalesce(F.col(text), F.lit(""))
    found = _let(tokens(whole), lambda w: F.when(F.size(w) >= k, mers(w)).otherwise(few(w)))
    rows = rows.select(*keep, F.when(whole.rlike(WORD), F.sort_array(found)).otherwise(none).alias(s))
    # First occurrences keep the k-mer's hash; later ones are hashed with their number.
    rows = rows.withColumn(u, F.filter(s, lambda x, i: (i == 0) | (_key(x) != _key(F.get(s, i - 1)))))
    again = F.filter(s, lambda x, i: (i > 0) & (_key(x) == _key(F.get(s, i - 1))))
    rows = rows.select(*keep, u, F.when(F.size(u) == F.size(s), none).otherwise(again).alias(r))
    starts = F.filter(upto(r, 1), lambda i: (i == 0) | (_key(F.get(r, i)) != _key(F.get(r, i - 1))))
    rows = rows.withColumn(f, F.when(F.size(r) == 0, F.array().cast("array<int>")).otherwise(starts))
    runs = F.transform(f, lambda a, j: F.transform(
        F.sequence(a, F.coalesce(F.get(f, j + 1), F.size(r)) - 1),
        lambda i: _pack(F.xxhash64(_key(F.get(r, i)), i - a + 1), F.get(r, i))))
    rows = rows.select(*keep, F.when(F.size(r) == 0, F.col(u)).otherwise(F.sort_array(F.concat(F.col(u), F.flatten(runs)))).alias(e))
    size = F.size(e)
    rings = min(rings, sketches)
    each = sketches // rings
    arc = (1 << 64) // each
    steps = F.sequence(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def one(ring: Column, halves: Column, point: Column) -> Column:
        # The number of elements before the arc's first point, by halves; the ring closes at the end.
        before = F.aggregate(halves, F.lit(0), lambda at, h: F.when(F.get(ring, at + h - 1) < point, at + h).otherwise(at))
        # Text order: place first, hash behind it.
        placed = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_MASK)), 32).bitwiseOR(F.shiftrightunsigned(x, 32))
        chosen = _let(before, lambda b: F.transform(F.sequence(F.lit(0), F.least(F.lit(tuple_size), size) - 1), lambda j: placed(F.get(ring, F.pmod(b + j, size)))))
        return F.xxhash64(F.transform(F.sort_array(chosen), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))))

    points = F.array(*[F.lit((i - each // 2) * arc).cast("long") for i in range(each)])
    powers = F.transform(steps, lambda h: F.call_function("shiftleft", F.lit(1), h))
    # The first ring is the elements' own order, the others hash them again, each with its number.
    order = lambda r: F.col(e) if r == 0 else F.sort_array(F.transform(e, lambda x: _pack(F.xxhash64(_key(x), F.lit(r)), x)))
    got = _let(powers, lambda halves: F.flatten(F.array(*[_let(order(r), lambda ring: F.transform(points, lambda p: one(ring, halves, p))) for r in range(rings)])))
    return rows.select(*keep, F.when(size == 0, F.array_repeat(F.lit(0).cast("long"), sketches)).otherwise(got).alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of equal sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x).cast("double") / F.size(a)


def as_text(sketches: str) -> Column:
    return F.array_join(F.transform(sketches, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(documents: DataFrame, blocks: int) -> DataFrame:
    """Every row of (doc_id, text, f) with next_text and next_f of the next one by (doc_id, text).

    Rows are dealt into ``blocks`` ranges of doc_id, whose bounds are quantiles of the ids (at most
    ``blocks`` longs). The first row of a range is dealt to the range before as well, the first of
    all to the last, so one shuffle brings every text to its neighbour. Null ids come first.
    """
    ids = documents.select("doc_id").agg(
        F.percentile_approx("doc_id", [i / blocks for i in range(blocks)], 100 * blocks).alias("q"),
        F.min("doc_id").alias("m"), F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    bounds = sorted({ids["m"], *(ids["q"] or [])} - {None}) or [0]
    last = len(bounds) - 1
    known = F.array(*[F.lit(x).cast("long") for x in bounds])
    rows = documents.select("doc_id", "text", "f").withColumn("__at", F.lit(0))
    # Binary search for the last bound at or below the id: one comparison a step.
    step = 1 << max(0, last.bit_length() - 1)
    while step:
        rows = rows.withColumn("__at", F.when((F.col("__at") + step <= last) & (F.get(known, F.col("__at") + step) <= F.col("doc_id")), F.col("__at") + step).otherwise(F.col("__at")))
        step //= 2
    begins = (F.get(known, F.col("__at")) == F.col("doc_id")) & (F.col("__at") > 0)
    first = F.col("doc_id").isNull() if ids["nulls"] else F.col("doc_id") == F.lit(ids["m"])
    place = lambda b, o: F.struct(b.cast("int").alias("b"), F.lit(o).alias("o"))
    places = F.filter(F.array(
        place(F.col("__at"), 0),
        F.when(begins, place(F.col("__at") - 1, 1)),
        F.when(first, place(F.lit(last), 2)),
    ), lambda x: x.isNotNull())
    dealt = rows.select("doc_id", "text", "f", F.explode(places).alias("p")).select("doc_id", "text", "f", "p.b", "p.o")
    w = Window.partitionBy("b").orderBy(F.col("o"), F.col("doc_id").asc_nulls_first(), "text")
    led = dealt.select("doc_id", "text", "f", "o", F.lead("text").over(w).alias("next_text"), F.lead("f").over(w).alias("next_f"))
    return led.where("o = 0").drop("o")


def edited(text: str, other: str) -> Column:
    """``text`` whose last half is replaced by as many first code points of ``other``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.char_length(text) - half), F.substring(F.col(other), F.lit(1), half))


def compare(documents: DataFrame, blocks: int, **options) -> DataFrame:
    """Fingerprints of every (doc_id, text) row, of its edited text, and their likenesses."""
    rows = with_next(sketch(documents, "text", "f", **options), blocks)
    rows = sketch(rows.withColumn("edited", edited("text", "next_text")), "edited", "g", **options)
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text("f").alias("fingerprint"), as_text("g").alias("edited_fingerprint"),
        likeness("f", "g").alias("near_edited"), likeness("f", "next_f").alias("near_next"),
    )
