"""What the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java pattern: space and 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Remainder 2 of crc32 of the id as text, of four; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text in order; none if it is null. Only the ends can give empty parts, so they are cut."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, SPACE))


def spare_prefix(columns: list[str]) -> str:
    """A beginning of names that none of ``columns`` has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


#: Spark's own limits of an Arrow batch, and ours.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of whole texts on either side of Python; limits that a session set itself stay."""
    for key, (given, ours) in _BATCH.items():
        if spark.conf.get(key, given) == given:
            spark.conf.set(key, ours)
