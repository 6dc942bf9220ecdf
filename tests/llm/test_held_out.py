"""Held-out labels and languages of the small test table: rows that the models never learn from."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity(spark):
    import __spark_entry__ as e

    got = e.queries()["op3_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.75
    said = [r for r in rows if r["predicted"] == 1]
    # 14 toxic rows are held out here; a precise label model is what the filter needs.
    assert len(said) >= 5 and sum(r["toxic"] for r in said) / len(said) > 0.7


def test_labels_are_no_target(spark):
    """A text without any sign of toxicity that is labelled toxic by mistake is not learned."""
    from edgeloom.llm import toxicity

    clean = [(i, f"a calm note about topic{i} and weather{i % 5}", int(i in (7, 19))) for i in range(200)]
    toxic = [(500 + i, f"you pathetic idiot topic{i} you are trash", 1) for i in range(60)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, [F.col("doc_id")]).collect()}
    assert got[7] == got[19] == 0 and all(got[500 + i] == 1 for i in range(60)) and sum(got.values()) == 60
    left = toxicity.clean(docs.withColumn("predicted", F.lit("x")), model)
    assert left.columns == ["doc_id", "text", "toxic", "predicted"] and left.count() == 200


def test_language(spark):
    import __spark_entry__ as e

    got = e.queries()["op1_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out and lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).collect()
    assert sum(r["ok"] for r in rows) / len(rows) > 0.97
