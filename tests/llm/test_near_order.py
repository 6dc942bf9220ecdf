"""The order that members' differences share, batch bounds, and sets made in small portions."""

import numpy as np

from edgeloom.llm.common import small_batches
from edgeloom.llm.near_dup import _differences
from edgeloom.llm.shingles import shingle_sets


def test_rare_differences_lead(spark):
    core = " ".join(f"core{i}" for i in range(60))
    # Half of the members share a tail, each has an ending of its own, one is the core itself.
    texts = [(i, core + (" shared tail of many words" if i % 2 else "") + f" own{i} end{i}") for i in range(8)] + [(8, core)]
    rows = spark.createDataFrame(texts, "cid long, text string")
    members = spark.createDataFrame([(1, i, i, 9) for i in range(9)], "cluster long, cid long, comp long, many long")
    got = {r["cid"]: r for r in _differences(members, rows, 3, 80).collect()}
    assert len(got) == 9 and got[8]["d"] == []
    often = {}
    for r in got.values():
        for e in r["d"]:
            often[e] = often.get(e, 0) + 1
    for r in got.values():
        assert [(often[e], e) for e in r["d"]] == sorted((often[e], e) for e in r["d"])
        assert r["slack"] == 20 * r["size"] - 180 * len(r["d"])
    assert max(often.values()) > 1


def test_sets_do_not_depend_on_portions():
    texts = ["", None, "a b c d e f", "x " * 500 + "y", "one two", "word " * 3000]
    for whole, small in zip(shingle_sets(texts, 4, 1 << 22), shingle_sets(texts, 4, 1)):
        assert np.array_equal(whole, small)


def test_own_batch_limits_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "77")
    try:
        small_batches(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)
    small_batches(spark)
    assert spark.conf.get(key) == "1000"
