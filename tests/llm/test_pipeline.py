"""Each stage on its own input, and the whole on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    columns = docs.columns
    seen = {}
    for name, stage in p.STAGES:
        out = p.materialise(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (docs.count(), out.count())
        if name != "packing":
            assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString()
        if name in ("toxicity", "near_dedup"):
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0 and out.count() <= docs.count()
        if name == "mixing":
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        docs = out
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert seen["packing"][1] >= seen["packing"][0] > 0
