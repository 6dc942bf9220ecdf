"""Readers and writers for edge lists and result files, the key~value file-name convention, grids."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from edgeloom import schema
from edgeloom.operators.graph import canonical_edges


def read_edge_list(spark: SparkSession, path: str, separator: str = " ", one_based: bool = False) -> DataFrame:
    """A headerless two-column edge list as a simple undirected edge table."""
    raw = spark.read.schema(schema.EDGES).option("sep", separator).option("comment", "#").csv(path)
    shift = F.lit(1 if one_based else 0)
    return canonical_edges(raw.where("src is not null and trg is not null").select((F.col("src") - shift).alias("src"), (F.col("trg") - shift).alias("trg")))


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.EDGES).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, kind: StructType, form: str = "csv") -> DataFrame:
    """Any artifact by its fixed schema (see ``edgeloom.schema``)."""
    reader = spark.read.schema(kind)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.option("header", True) if form == "csv" else writer
    (writer.partitionBy(*by) if by else writer).format(form).save(path)


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def filename_params(name: Column) -> Column:
    """The key~value tokens of a name that ``_`` joins, as a map; other tokens are dropped."""
    pairs = F.filter(F.split(name, "_"), lambda t: t.contains("~"))
    return F.map_from_entries(F.transform(pairs, lambda t: F.struct(F.split_part(t, F.lit("~"), F.lit(1)), F.split_part(t, F.lit("~"), F.lit(2)))))


def read_with_params(spark: SparkSession, paths: str | list[str], kind: StructType, keys: Sequence[str]) -> DataFrame:
    """CSV files with the parameters of their names as columns."""
    df = spark.read.schema(kind).option("header", True).csv(paths).withColumn("filename", F.col("_metadata.file_path"))
    params = filename_params(stem(F.col("filename")))
    return df.withColumns({k: F.try_element_at(params, F.lit(k)) for k in keys})


def parse_params(keys: str, sep: str = "~") -> dict[str, str]:
    """The same tokens of one string on the driver."""
    return {k: v for k, found, v in (t.partition(sep) for t in keys.split("_")) if found}


def to_numeric(df: DataFrame, to_int: Sequence[str] = (), to_float: Sequence[str] = ()) -> DataFrame:
    """Best-effort casts: a column whose values don't all convert stays as it is."""
    todo = [(c, DoubleType()) for c in to_float if c in df.columns] + [(c, LongType()) for c in to_int if c in df.columns]
    if not todo:
        return df
    tests = [F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull()).alias(f"{i}") for i, (c, t) in enumerate(todo)]
    bad = df.agg(*tests).first()
    return df.withColumns({c: F.col(c).cast("string").try_cast(t) for i, (c, t) in enumerate(todo) if not bad[f"{i}"]})


def list_networks(names: Iterable[str], pattern: str = r"net_([^.]+)\.") -> list[str]:
    """Data set names from file names."""
    return sorted({m[1] for n in names if (m := re.search(pattern, n))})


def small_networks(stats: DataFrame, max_nodes: int = 20_000) -> DataFrame:
    return stats.where(F.col("n_nodes") <= max_nodes).select("network")


def param_grid(spark: SparkSession, params: Mapping[str, Sequence]) -> DataFrame:
    """The cartesian product of value lists, one column a key, in the keys' order."""
    rows = list(itertools.product(*params.values()))
    return spark.createDataFrame(rows, list(params))


def union_grid(spark: SparkSession, grids: Sequence[Mapping[str, Sequence]]) -> DataFrame:
    out = param_grid(spark, grids[0])
    for g in grids[1:]:
        out = out.unionByName(param_grid(spark, g), allowMissingColumns=True)
    return out


def expand(template: str, **params) -> list[str]:
    """Fill every combination of the given values into a template; unknown fields stay."""
    lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in params.items()}
    out = []
    for row in itertools.product(*lists.values()):
        text = template
        for k, v in zip(lists, row):
            text = text.replace("{" + k + "}", str(v))
        out.append(text)
    return list(dict.fromkeys(out))


def make_filename(prefix: str, ext: str, names: Sequence[str]) -> str:
    return prefix + "_" + "_".join(f"{n}~{{{n}}}" for n in names) + f".{ext}"


def constrain_by(values: Sequence[str]) -> str:
    return "(" + "|".join(re.escape(str(v)) for v in values) + ")"
