"""Degrees of an edge stream, kept up to date (an extension: batch results equal ``graph.degrees``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom import schema


def edge_stream(spark: SparkSession, folder: str, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema.EDGES).format(form).load(folder)


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """(u, k) of a stream of distinct edges, for update or complete mode."""
    ends = edges.select(F.explode(F.when(F.col("src") == F.col("trg"), F.array("src")).otherwise(F.array("src", "trg"))).alias("u"))
    return ends.groupBy("u").agg(F.count(F.lit(1)).alias("k"))


def windowed_edge_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Edges a window of event time ``ts``; rows later than the watermark are dropped."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()
