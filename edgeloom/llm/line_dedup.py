"""Line dedup by spread over sites.

Every line's hash gets a HyperLogLog sketch of the distinct sources it occurs in, built from the lines
themselves; sketches merge by aggregation, within tasks first, so a line that is on every page
shuffles one sketch a task. A line whose estimate is clearly above the threshold is boilerplate by its
sketch; only lines whose estimate is near it get an exact distinct count, from a second look at the
documents. A line on ``min_sites`` sources or more is removed everywhere but where it occurs first
(smallest doc_id, and there its first occurrence), so the corpus keeps one copy.

Lines are compared without white space at their ends, by a 64-bit hash; lines of fewer than
``min_words`` words never count.

Defined results: null text stays null, has no lines and is kept as it is; null sources are one
source; rows that repeat a doc_id share its decisions, and each of them keeps the copy that the doc_id
keeps; rows without an id lose every boilerplate line that an id has; a document that loses its last
line with a word is emptied (and ``clean`` drops it); texts and lines of any length are treated
whole; empty tables give empty results; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import SPACE, WORD, spare_prefix
from edgeloom.storage import materialise

_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """64 bits of a trimmed line; null if it has too few words to count."""
    return F.xxhash64(F.regexp_replace(line, _ENDS, ""))


def _counts(line: Column, min_words: int) -> Column:
    if min_words <= 1:
        return line.rlike(WORD)
    return line.rlike(WORD + f"(?:{SPACE}{WORD}){{{min_words - 1}}}")


def _coded(text: Column, min_words: int) -> Column:
    """For each line its hash, or null if it never counts."""
    return F.transform(_lines(text), lambda x: F.when(_counts(x, min_words), _hash(x)))


def _said(documents: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, site, line) of every distinct counting line of a document."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    lines = F.array_distinct(F.filter(_coded(F.col("text"), min_words), lambda h: h.isNotNull()))
    return documents.where("text is not null").select("doc_id", site.alias("site"), F.explode(lines).alias("line"))


def boilerplate(documents: DataFrame, min_sites: int = 10, min_words: int = 1, band: float = 0.25, log_k: int = 8) -> DataFrame:
    """(line, first_doc, sites) of every line hash that ``min_sites`` sources or more have.

    ``band``: estimates within this share of the threshold are counted exactly. At ``log_k`` 8 the
    sketch's standard error is 6.5 %, and it is exact while a line has few sources.
    """
    said = _said(documents, min_words)
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", log_k)).alias("estimate")
    spread = said.groupBy("line").agg(estimate, F.min("doc_id").alias("first_doc"))
    spread = materialise(spread.where(F.col("estimate") >= min_sites * (1 - band)), "line-spread")
    sure = spread.where(F.col("estimate") > min_sites * (1 + band)).select("line", "first_doc", F.col("estimate").alias("sites"))
    near = spread.where(F.col("estimate") <= min_sites * (1 + band)).select("line", "first_doc")
    # The second look at a near line that very many documents of its few sites have comes salted.
    salts = 16
    dealt = said.select("line", "site", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    wanted = near.select("line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = dealt.join(wanted.hint("merge"), ["line", "salt"], "left_semi").select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(near.join(exact, "line").select("line", "first_doc", "sites"))


def decisions(documents: DataFrame, found: DataFrame, min_words: int = 1, salts: int = 16) -> DataFrame:
    """(doc_id, drop, once): hashes of boilerplate lines that a doc_id has; ``once`` keeps the first."""
    mine = _said(documents.where("doc_id is not null"), min_words).select("doc_id", "line")
    mine = mine.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    each = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = mine.join(each.hint("merge"), ["line", "salt"]).select("doc_id", "line", (F.col("doc_id") == F.col("first_doc")).alias("first"))
    # No more hashes than a document has lines.
    return hit.groupBy("doc_id").agg(F.collect_set(F.when(~F.col("first"), F.col("line"))).alias("drop"), F.collect_set(F.when(F.col("first"), F.col("line"))).alias("once"))


def dedup(documents: DataFrame, min_sites: int = 10, min_words: int = 1) -> DataFrame:
    """Every row of ``documents`` and its columns, and a struct as the last column.

    The struct has n_lines (lines with a word), n_removed, emptied and text (what is left).
    """
    pre = spare_prefix(documents.columns)
    doc, drop, once, p, c, k, out = (f"{pre}{x}" for x in ("doc", "drop", "once", "parts", "codes", "kept", "lines"))
    found = materialise(boilerplate(documents, min_sites, min_words), "boilerplate")
    taken = materialise(decisions(documents, found, min_words), "line-decisions")
    taken = taken.select(F.col("doc_id").alias(doc), F.col("drop").alias(drop), F.col("once").alias(once))
    # A merge at every size: what is broadcast while it is small would be another plan when it isn't.
    rows = documents.join(taken.hint("merge"), documents["doc_id"] == taken[doc], "left")
    parts, codes = _lines(F.col("text")), _coded(F.col("text"), min_words)
    touched = F.col("text").isNotNull() & F.col(doc).isNotNull()
    rows = rows.withColumn(p, F.when(touched, parts)).withColumn(c, F.when(touched, codes))
    # A line stays if it isn't boilerplate, or is its first occurrence in the document that has it first.
    stays = lambda x, i: F.get(c, i).isNull() | ~(F.array_contains(drop, F.get(c, i)) | (F.array_contains(once, F.get(c, i)) & (F.array_position(c, F.get(c, i)) != i + 1)))
    rows = rows.withColumn(k, F.when(touched, F.filter(p, lambda x, i: F.coalesce(stays(x, i), F.lit(True)))))
    text = F.when(touched, F.array_join(k, "\n")).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: x.rlike(WORD))))
    n_removed = F.when(touched, F.size(p) - F.size(k)).otherwise(0)
    emptied = (n_removed > 0) & ~F.coalesce(text.rlike(WORD), F.lit(False))
    result = F.struct(n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), emptied.alias("emptied"), text.alias("text"))
    # One element, exploded: a filter on the struct stays above it. Below, the optimizer would write the
    # arrays into the filter, and their lambdas would split and hash the text again for each line.
    return rows.select(*[documents[x] for x in documents.columns], F.explode_outer(F.array(result)).alias(out))


def clean(documents: DataFrame, **options) -> DataFrame:
    """``documents`` without boilerplate lines and without the rows that these emptied."""
    rows = dedup(documents, **options)
    got, kinds = rows.columns[-1], dict(documents.dtypes)
    left = F.col(f"{got}.text")
    kept = [left.alias("text") if x == "text" else F.char_length(left).cast(kinds[x]).alias(x) if x == "n_chars" else F.col(x) for x in documents.columns]
    return rows.where(~F.col(f"{got}.emptied")).select(*kept)
