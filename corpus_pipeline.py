"""The corpus pipeline: documents to packed sequences, in stages.

Each stage reads what the one before it kept (written as Parquet and read again) and its decisions
take effect: toxic documents go, cross-site lines go (with documents that they emptied), one document
of each group of near-duplicates stays, documents are repeated or left out to meet the sources'
targets, and what remains is packed.

Defined results: the stages' modules say what they do with nulls, empty and very long texts, ties, repeated
rows, empty tables and other columns; a stage passes on every column of ``documents``. Null and empty texts
are never toxic, have no lines and no copies, and are packed as an end mark alone. Near duplicates are taken at
five words, as training corpora mostly are; the query of that operator alone has its own contract of four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import line_dedup, mixing, near_dup, packing, queries, toxicity
from edgeloom.llm.common import is_held_out, table
from edgeloom.storage import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").where(~is_held_out()), labels.where(~is_held_out()))
    return toxicity.clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the cube draws; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
