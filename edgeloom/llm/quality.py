"""Quality rules with verdicts by host, in DataFrame operations only.

Each document is judged by rules on its own text. Failures are added up by host (``source``), a beta
prior is fitted to the hosts' failure rates by moments, and every host's rate is shrunk to the
prior's mean; a host whose shrunk rate is above the limit rejects all its documents.

Repeated three-word windows are found within the row: windows' 64-bit hashes are packed with their
positions and sorted as primitives, so a text of any length costs n log n and nothing is exploded.

Defined results: null text has no words and fails; null sources are one host; repeated rows count
each time; with a single host the prior is weak (``least`` documents' worth) and the rate its own;
a host whose rate is exactly the limit passes; texts of any length are judged whole; empty tables give
empty results; other columns are ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import WORD, words
from edgeloom.storage import lookup_join, materialise

_POS = 24
_MASK = (1 << _POS) - 1


def _key(x: Column) -> Column:
    return F.shiftright(x, _POS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK)).cast("int")


def base_rules(rows: DataFrame, text: str, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("__w", words(F.col(text)))
    rows = rows.withColumn("__t", F.when(F.size("__w") < 3, none).otherwise(F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))))
    rows = rows.withColumn("__s", F.sort_array(F.transform("__t", lambda h, i: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_MASK))))))
    near = lambda x, j: F.coalesce(_key(F.get("__s", j)) == _key(x), F.lit(False))
    rows = rows.withColumn("__d", F.filter("__s", lambda x, i: near(x, i + 1) | ((i > 0) & near(x, F.greatest(i - 1, F.lit(0))))))
    whole = lambda x: F.get("__t", _place(x))
    # Two windows whose 40 sorted bits agree and whose 64 don't: then, or beyond 2^24 words, whole hashes are sorted.
    clash = (F.size("__t") > _MASK) | ((F.size("__d") > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size("__d") - 1, F.lit(1))), lambda j: (_key(F.get("__d", j)) == _key(F.get("__d", j - 1))) & (whole(F.get("__d", j)) != whole(F.get("__d", j - 1)))))
    pairs = lambda: F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alike = lambda a, x, i: F.coalesce(F.get(a, i + 1)["h"] == x["h"], F.lit(False)) | ((i > 0) & F.coalesce(F.get(a, F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))
    slow = F.get(F.transform(F.array(pairs()), lambda a: F.sort_array(F.transform(F.filter(a, lambda x, i: alike(a, x, i)), lambda x: x["i"]))), F.lit(0))
    rows = rows.withColumn("__r", F.when(F.size("__d") == 0, F.array().cast("array<int>")).when(clash, slow).otherwise(F.sort_array(F.transform("__d", _place))))
    covered = F.aggregate(F.transform("__r", lambda p, j: F.least(F.coalesce(F.get("__r", j + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("__l", lines)
    n = F.size("__w")
    rows = rows.select(
        *[c for c in rows.columns if c not in ("__w", "__t", "__s", "__d", "__r", "__l")],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(round(100 * max_repeat)) * F.col("n_words")))


def host_verdicts(judged: DataFrame, limit: float = 0.5, least: float = 2.0) -> DataFrame:
    """host_key, n_docs, shrunk_rate, host_passed from rows of (host_key, base_failed)."""
    hosts = materialise(judged.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1.0 / F.col("n_docs")).alias("inv")).first()
    mean = m["m"] if m["m"] is not None else 0.0
    spread = mean * (1 - mean)
    # Variance between hosts = observed variance less the binomial part; its ratio to mean*(1-mean) is 1/(a+b+1).
    between = max((m["v"] or 0.0) - spread * (m["inv"] or 0.0), 0.0)
    strength = least if not spread or m["v"] is None else max(least, min(1e6, spread / between - 1 if between else 1e6))
    shrunk = (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host_key", "n_docs", shrunk.alias("shrunk_rate"), (shrunk <= limit).alias("host_passed"))


def judge(documents: DataFrame, limit: float = 0.5) -> DataFrame:
    """doc_id, the rules' counts, base_failed, the host's shrunk rate and kept of every row."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    base = base_rules(documents.select("doc_id", key.alias("host_key"), "text"), "text").drop("text")
    base = materialise(base, "quality-base")
    out = lookup_join(base, materialise(host_verdicts(base, limit), "host-verdicts"), "host_key", "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("shrunk_rate", 6).alias("shrunk_rate"), (~F.col("base_failed") & F.col("host_passed")).alias("kept"))
