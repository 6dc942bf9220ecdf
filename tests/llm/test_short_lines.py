"""Lines of one and two words are boilerplate by their spread, as longer ones are."""

import hashlib
import re


def rows(spark):
    lines = lambda i: [f"only here {i} of all", "Les." if i % 2 else " Les. ", "And ornd." if i < 9 else "Rare one", "...", "", f"x{i}"]
    return spark.createDataFrame([(i, "\n".join(lines(i)), f"s{i}") for i in range(20)], "doc_id long, text string, source string")


def brute(docs):
    """What stays of each text."""
    sites, first = {}, {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for d, t, s in docs:
        for x in t.split("\n"):
            if key(x):
                sites.setdefault(key(x), set()).add(s)
                first[key(x)] = min(d, first.get(key(x), d))
    return {d: "\n".join(x for x in t.split("\n") if not key(x) or len(sites[key(x)]) < 10 or first[key(x)] == d) for d, t, _ in docs}


def test_query(spark, tmp_path):
    import __spark_entry__ as e

    docs = rows(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([tuple(r) for r in docs.collect()])
    assert sum("Les." in t for t in want.values()) == 1 and sum("Rare one" in t for t in want.values()) == 1
    got = e.queries()["op6_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    assert all(r["n_lines"] == 5 for r in got)


def test_pipeline_stage(spark):
    import corpus_pipeline as p

    docs = rows(spark)
    want = brute([tuple(r) for r in docs.collect()])
    assert {r["doc_id"]: r["text"] for r in p.drop_lines(spark, docs, "none").collect()} == want
    assert not re.search("Les", want[7])
