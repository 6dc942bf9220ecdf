"""Columns of the input that are named like the operators' own."""

from edgeloom.llm import line_dedup, mixing


def test_clashing_columns(spark):
    rows = [(i, f"the same line\ntext {i} of its own", f"s{i}", f"a{i}", i, "x", "y", [1]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id string, __copies int, __p string, __doc string, __lines array<int>")
    left = line_dedup.clean(docs)
    assert left.columns == docs.columns and left.count() == 12
    assert sorted("same" in r["text"] for r in left.collect()) == [False] * 11 + [True]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert all(r["__id"] == f"a{r['doc_id']}" and r["__copies"] == r["doc_id"] for r in mixed.collect())
