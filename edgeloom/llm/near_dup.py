"""MinHash near-duplicates: minima, bands, verification on full sets, connected components.

1. Each text gets its shingle set's 128-bit hash, minima of many universal hash functions and one key
   a band. Texts with equal sets form a class, so copies, however many, are one row from here on.
2. Classes with a key in common meet in a bucket, which pairs its first class with the others and
   emits no other pairs. Pairs whose minima agree enough are verified on full sets, and verified links go
   to the components (large-star / small-star).
3. A bucket whose members are one component is done. Another one still hides links only among members
   of different components. Up to ``few`` of them are paired directly, a constant number of pairs a
   row. Larger buckets are split: buckets that share members form a cluster, and a member is described
   by its difference D from the cluster's core (shingles that most members have). Two sets x, y are
   similar exactly if D(x) and D(y) have a number of elements in common that follows from their sizes, so
   in any order of elements they share one among the first of each (prefix filter, by that number). New
   buckets are these first elements; near copies that are unlike each other share none. A new bucket
   that is still large forms clusters, with cores, of its own.

No pair of classes with a key in common whose components differ stays uncompared; whatever is not
paired directly is ruled out by the counting argument, not by chance. With 24 bands of 4 rows a pair of
similarity 0.8 shares no key with probability 3e-6; the agreement of minima that is asked for is five
standard deviations below the threshold.

Defined results: null and empty texts link with nothing; a null doc_id links with nothing and has a
null component; rows of one doc_id are one document, which has the links of each of its texts (its row
has the count of its own text); equal rows get equal results; ties between classes don't matter, as a
component is named by its smallest doc_id; texts of any length are compared whole; empty tables
give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import WORD, small_batches
from edgeloom.llm.shingles import Minima, shingle_sets, similar
from edgeloom.operators.components import star_components
from edgeloom.storage import materialise, width_for


def signatures(documents: DataFrame, k: int, minima: Minima) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, signature, keys of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                b = batch.iloc[i : i + 512]
                sets = shingle_sets(b["text"].tolist(), k)
                signs = [minima.signature(s) if len(s) else None for s in sets]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].astype("Int64").to_numpy(),
                    "text_hash": b["text_hash"].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "signature": [x.tobytes() if x is not None else None for x in signs],
                    "keys": [minima.keys(x) if x is not None else None for x in signs],
                })

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, signature binary, keys array<long>")


def _salt(column: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int").alias("salt")


def _with_both(pairs: DataFrame, rows: DataFrame, value: str, salts: int = 16) -> DataFrame:
    """(a, b, va, vb): pairs with a value of either side, sorted by a within tasks.

    An ``a`` may have very many pairs: its value comes once for each salt that its pairs have. Merges
    at every size: what is broadcast while it is small would be another plan when it isn't.
    """
    side = lambda c, v: rows.select(F.col("cid").alias(c), F.col(value).alias(v))
    left = pairs.hint("merge").join(side("b", "vb"), "b").select("a", _salt("b", salts), "b", "vb")
    heads = pairs.select("a", _salt("b", salts)).distinct().hint("merge").join(side("a", "va"), "a")
    return left.hint("merge").join(heads, ["a", "salt"]).select("a", "b", "va", "vb")


def _agree(pairs: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose minima agree in a share of ``least`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(b["va"]), dtype=np.uint32).reshape(len(b), -1)
                y = np.frombuffer(b"".join(b["vb"]), dtype=np.uint32).reshape(len(b), -1)
                yield b.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]

    return _with_both(pairs, signs, "signature").mapInPandas(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar, on full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, of = None, None
        for batch in batches:
            for i in range(0, len(batch), 256):
                b = batch.iloc[i : i + 256]
                sets = shingle_sets(b["vb"].tolist(), k)
                ok = []
                for a, head, s in zip(b["a"], b["va"], sets):
                    if a != at:
                        at, of = a, shingle_sets([head], k)[0]
                    ok.append(similar(of, s, percent))
                yield b.loc[ok, ["a", "b"]]

    return _with_both(pairs, texts, "text").mapInPandas(run, "a long, b long")


def _label(rows: DataFrame, comps: DataFrame | None, column: str, out: str) -> DataFrame:
    if comps is None:
        return rows.withColumn(out, F.col(column))
    known = comps.select(F.col("node").alias(column), F.col("component").alias("__c"))
    return rows.join(known, column, "left").withColumn(out, F.coalesce("__c", column)).drop("__c")


def _open(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(key, cid, comp, n, first) of the buckets (key, cid) whose members are of several components."""
    rows = _label(buckets, comps, "cid", "comp")
    per = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("cid").alias("first"))
    return rows.join(per.where("lo <> hi").select("key", "n", "first"), "key")


def _members(opened: DataFrame) -> DataFrame:
    """(cluster, cid, comp, many): members of open buckets, ``many`` of them in the cluster."""
    groups = materialise(star_components(opened.select("first", "cid"), local=True), "near-clusters")
    groups = groups.withColumnRenamed("component", "cluster").withColumnRenamed("node", "cid")
    # A cluster may have a third of all rows: its count comes in salted copies.
    salts = 32
    counts = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("many")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sized = groups.select("cluster", "cid", _salt("cid", salts)).join(counts.hint("merge"), ["cluster", "salt"]).drop("salt")
    return sized.join(opened.select("cid", "comp").distinct(), "cid")


def _differences(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(cluster, cid, comp, size, d, slack): each member's set size and its difference from its cluster's
    core, as an array in an order that all of a cluster share: elements that fewer members differ by first, ties by
    hash. Rare elements lead, so what many members differ by makes no buckets while there is anything else.

    ``slack``: (100 - percent) * size - (100 + percent) * |d|; x and y are similar exactly if d(x) and d(y)
    have -(slack(x) + slack(y)) / (2 * (100 + percent)) elements in common, or more.
    """

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                b = batch.iloc[i : i + 256]
                yield pd.DataFrame({**{c: b[c] for c in ("cluster", "cid", "comp", "many")}, "e": [s.view(np.int64) for s in shingle_sets(b["text"].tolist(), k)]})

    kept = "cluster long, cid long, comp long, many long"
    sets = materialise(texts.join(members.hint("merge"), "cid").select("cluster", "cid", "comp", "many", "text").mapInPandas(shingles, kept + ", e array<long>"), "near-sets")
    counted = sets.select("cluster", "many", F.explode("e").alias("e")).groupBy("cluster", "many", "e").agg(F.count(F.lit(1)).alias("n"))
    # At most twice as many elements as the cluster's sets have on average: a text's worth.
    salts = 32
    core = counted.where(2 * F.col("n") > F.col("many")).groupBy("cluster").agg(F.sort_array(F.collect_list("e")).alias("core")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = sets.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int")).hint("merge").join(core, ["cluster", "salt"], "left").drop("salt", "many")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64)
        for b in batches:
            d = []
            for e, c in zip(b["e"], b["core"]):
                e, c = np.asarray(e, dtype=np.int64), none if c is None else np.asarray(c, dtype=np.int64)
                d.append(np.concatenate([np.setdiff1d(e, c, assume_unique=True), np.setdiff1d(c, e, assume_unique=True)]))
            size = b["e"].str.len()
            yield pd.DataFrame({**{x: b[x] for x in ("cluster", "cid", "comp")}, "size": size, "d": [np.concatenate([x]) for x in d], "slack": (100 - percent) * size - (100 + percent) * pd.Series([len(x) for x in d], index=b.index)})

    raw = materialise(both.mapInPandas(run, "cluster long, cid long, comp long, size long, d array<long>, slack long"), "near-differences")
    each = raw.select("cluster", "cid", F.explode("d").alias("e"))
    often = each.groupBy("cluster", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rated = each.join(often.hint("merge"), ["cluster", "e"], "left").select("cid", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "e").alias("x"))
    ordered = rated.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["e"]).alias("d"))
    out = raw.drop("d").join(ordered.hint("merge"), "cid", "left").withColumn("d", F.coalesce("d", F.array().cast("array<long>")))
    return materialise(out, "near-ordered")


def _split(diffs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The clusters' links by counting alone, (a, b), and new buckets:
    (key, cid, comp, size, length, at, slack, hub, head).

    The member with the most slack is the hub: whoever is similar to any member whatever their
    differences are is so to the hub. ``head``: the element is among the first that a member must share with
    a partner of a larger difference; other rows are for being a head's partner only.
    """
    p, q = 100 + percent, 100 - percent
    salts = 32
    hubs = diffs.groupBy("cluster").agg(F.max(F.struct("slack", "cid")).alias("h")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = diffs.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int")).hint("merge").join(hubs, ["cluster", "salt"]).drop("salt")
    best = F.col("h.slack")
    rows = rows.withColumn("hub", F.col("slack") + best >= 0).withColumn("length", F.size("d"))
    links = rows.where("hub and cid <> h.cid").select(F.col("h.cid").alias("a"), F.col("cid").alias("b"))
    # The least number of common elements with a partner outside the hub's links, or with any for a member outside.
    common = F.when(F.col("hub"), best - F.col("slack")).otherwise(-F.col("slack") - best)
    reach = F.col("size") * q * (100 + percent) / percent  # (100 - percent) * (size + the largest partner's size)
    at_least = lambda c: F.greatest(F.lit(1), F.ceil(common / (2 * p)), F.ceil(c - F.lit(1e-9))).cast("int")
    n_head = F.col("length") - at_least(F.col("length") - reach / (2 * p)) + 1
    n_all = F.col("length") - at_least(F.col("length") - reach / p) + 1
    rows = rows.select("*", n_head.alias("n_head"), F.greatest(n_head, n_all, F.lit(0)).alias("n_all")).where("n_all > 0")
    out = rows.select("cluster", "cid", "comp", "size", "length", "slack", "hub", "n_head", F.posexplode(F.slice("d", F.lit(1), F.col("n_all"))).alias("at", "e"))
    return links, out.select(F.struct("cluster", "e").alias("key"), "cid", "comp", "size", "length", "at", "slack", "hub", (F.col("at") < F.col("n_head")).alias("head"))


def _split_pairs(split: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of new buckets: a head with partners whose differences are no smaller, if the
    elements that may follow in both orders suffice."""
    x, y = split.where("head").alias("x"), split.alias("y")
    need = -(F.col("x.slack") + F.col("y.slack")) / (2 * (100 + percent))
    rest = 1 + F.least(F.col("x.length") - F.col("x.at"), F.col("y.length") - F.col("y.at")) - 1
    fits = (F.col("x.comp") != F.col("y.comp")) & ~(F.col("x.hub") & F.col("y.hub")) & (rest >= need) & (F.col("x.size") * 100 >= F.col("y.size") * percent) & (F.col("y.size") * 100 >= F.col("x.size") * percent)
    order = F.struct("x.length", "x.cid") < F.struct("y.length", "y.cid")
    pairs = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & order & fits)
    return pairs.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, few: int = 8, most: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text).

    ``few``: members of a bucket that are paired directly; ``most``: heads of a bucket that others are held against.
    """
    small_batches(documents.sparkSession)
    minima = Minima(bands, rows)
    share = percent / 100
    least = max(0.0, share - 5 * math.sqrt(share * (1 - share) / (bands * rows)))
    marks = materialise(signatures(documents, k, minima), "near-signatures")
    whole = marks.where("set_hash is not null and doc_id is not null")
    classes = whole.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    # A number for each class, for good once it is written.
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "set_hash", F.col("head.doc_id").alias("rep"), F.col("head.text_hash").alias("text_hash"), "signature", "keys"), "near-classes")
    # Rows of one doc_id with different texts are one document: their classes are linked.
    twice = whole.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("z")).where("a <> z").select("doc_id", "a")
    same = materialise(whole.select("doc_id", "set_hash").join(twice, "doc_id").where("a <> set_hash").select("a", "set_hash").distinct(), "near-same")
    comps = None
    if not same.isEmpty():
        number = lambda c: classes.select(F.col("cid").alias(f"{c}_cid"), F.col("set_hash").alias(c))
        comps = materialise(star_components(same.join(number("a"), "a").join(number("set_hash"), "set_hash").select("a_cid", "set_hash_cid"), local=True), "near-components")
    signs = classes.select("cid", "signature")
    keyed = classes.select("cid", F.explode("keys").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "near-keys")
    buckets = materialise(keyed.join(shared, "key").where("cid <> first"), "near-buckets")
    # What follows is about classes that share a key: usually few, so few tasks for tables of numbers.
    width = width_for(documents.sparkSession, buckets.count())
    wanted = buckets.select("cid").union(buckets.select("first")).distinct().join(classes.select("cid", "rep", "text_hash"), "cid")
    full = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    full = full.join(wanted.hint("merge"), ["rep", "text_hash"]).groupBy("rep", "text_hash", "cid").agg(F.first("text").alias("text"))
    texts = materialise(full.select("cid", "text"), "near-texts")

    def linked(pairs: DataFrame, known: DataFrame | None, sure: DataFrame | None = None) -> DataFrame | None:
        """The components with the links among ``pairs`` and those that are ``sure``."""
        pending = _agree(pairs, signs, least)
        if known is not None:
            pending = _label(_label(pending, known, "a", "ca"), known, "b", "cb").where("ca <> cb").select("a", "b")
        found = _verify(materialise(pending, "near-candidates"), texts, k, percent)
        found = materialise(found if sure is None else found.union(sure), "near-links")
        if found.isEmpty():
            return known
        stars = found if known is None else known.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found)
        return materialise(star_components(stars, local=True), "near-components", width)

    comps = linked(buckets.select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct(), comps)
    # The first of a bucket has met all others and leaves it.
    opened = materialise(_open(buckets.select("key", "cid"), comps), "near-open", width)
    size = -1
    while True:
        small = opened.where(F.col("n") <= few).select("key", "cid", "comp")
        x, y = small.alias("x"), small.alias("y")
        pairs = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.comp") != F.col("y.comp"))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
        large = opened.where(F.col("n") > few)
        if large.isEmpty():
            if size < 0:
                comps = linked(pairs, comps)
            break
        members = materialise(_members(large), "near-members", width)
        before, size = size, members.count()
        links, split = _split(_differences(members, texts, k, percent), percent)
        split = materialise(split, "near-split")
        heads = split.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("head").alias("heads"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cid").alias("first")).where("n > 1 and heads > 0 and lo <> hi")
        split = materialise(split.join(heads.select("key", "n", "heads", "first"), "key"), "near-split-open", width)
        # Splitting goes on while it at least halves what is open; then the counting argument alone decides.
        done = 0 <= before < 2 * size
        busy = F.col("heads") > most
        direct = _split_pairs(split if done else split.where(~busy), percent)
        comps = linked((pairs.union(direct)).distinct() if before < 0 else direct, comps, links)
        if done:
            break
        opened = split.where(busy).select(F.xxhash64("key").alias("key"), "cid")
        opened = materialise(_open(opened, comps).where(F.col("n") > few), "near-open", width)
        if opened.isEmpty():
            break
    if comps is not None:
        # A component is named by its smallest doc_id.
        named = comps.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
        salts = 32
        least_of = named.groupBy("component").agg(F.min("rep").alias("name")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        names = named.select("component", F.col("node").alias("cid"), _salt("node", salts)).join(least_of.hint("merge"), ["component", "salt"]).select("cid", "name")
        heads = classes.select("cid", "set_hash", "rep").join(names, "cid", "left").select("set_hash", F.coalesce("name", "rep").alias("component"))
    else:
        heads = classes.select("set_hash", F.col("rep").alias("component"))
    # A class may have a third of all rows: its one row comes in salted copies.
    salts = 32
    left = marks.select("doc_id", "n_shingles", "set_hash", _salt("doc_id", salts))
    right = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = left.join(right, ["set_hash", "salt"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one row of each component.

    Of rows that repeat a kept doc_id the first by text stays. Rows without an id are in no component:
    of those with equal texts one stays, and all without a word.
    """
    judged = materialise(near_duplicates(documents.select("doc_id", "text"), **options), "near-judged")
    per = judged.groupBy("doc_id").agg(F.min(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = materialise(per.where("kept = 0 or n > 1 or doc_id is null"), "near-odd")
    gone = odd.where("doc_id is not null").select("doc_id")
    out = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    more = odd.where("kept = 1 and n > 1").select("doc_id")
    if more.isEmpty():
        return out
    whole = F.struct(*[F.col(c) for c in documents.columns]).alias("row")
    order = F.struct(F.col("text"), F.xxhash64(*documents.columns)).alias("at")
    again = documents.join(more, "doc_id", "left_semi")
    first = again.select(whole, order).groupBy("row.doc_id").agg(F.min_by("row", "at").alias("row")).select("row.*")
    nameless = documents.where("doc_id is null").select(whole, order, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("said"))
    texts = nameless.where("said").groupBy("t").agg(F.min_by("row", "at").alias("row"))
    return out.where("doc_id is not null").unionByName(first).unionByName(texts.select("row.*")).unionByName(nameless.where("not said").select("row.*"))
