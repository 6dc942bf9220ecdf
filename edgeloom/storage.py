"""Tables that cut lineage, and joins that stay even when one key is hot.

Everything that has to outlive a plan (a loop's state, a shared sub-result) is written as Parquet
below the folder that ``spark.checkpoint.dir`` names, which driver and executors share, so a lost
executor costs recomputation of tasks and never of results already written.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables go if no folder is set; used with a local master only.
LOCAL_SCRATCH = "/tmp/checkpoints/edgeloom"
#: Makes Spark delete an action's shuffle files at its end, not when the driver's garbage collector finds them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: DataFrames that read a table of ours; the tables written since each ``settled`` that is under way.
_WRITTEN: weakref.WeakSet = weakref.WeakSet()
_OPEN: list[list[Table]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's, else one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = LOCAL_SCRATCH if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


class Table:
    """A DataFrame written once: ``df`` reads it back, ``drop()`` deletes its files.

    ``width`` bounds the tasks and files of a table that is known to be small.
    """

    def __init__(self, df: DataFrame, tag: str, width: int | None = None):
        spark = df.sparkSession
        df = df if width is None else df.coalesce(width)
        self.path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _WRITTEN.add(self.df)
        if _OPEN:
            _OPEN[-1].append(self)

    def drop(self) -> None:
        spark = self.df.sparkSession
        _WRITTEN.discard(self.df)
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, tag: str, width: int | None = None) -> DataFrame:
    """``df`` written and read back; one that reads a written table already stays as it is."""
    return df if df in _WRITTEN else Table(df, tag, width).df


def view(df: DataFrame) -> DataFrame:
    """``df``, which picks or unites rows of written tables: reading it costs no more than a table of its own would."""
    _WRITTEN.add(df)
    return df


def settled(make: Callable[[], DataFrame], tag: str, keep: bool = False) -> DataFrame:
    """What ``make`` returns, written; the tables that were written on the way are deleted then.

    Nothing else may read those. An outer ``settled`` deletes the result too, unless ``keep``.
    """
    _OPEN.append([])
    out = None
    try:
        out = Table(make(), tag)
    finally:
        for t in _OPEN.pop():
            if t is not out and t.df in _WRITTEN:
                t.drop()
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    return out.df


def width_for(spark: SparkSession, rows: int, each: int = 100_000) -> int:
    """Tasks for a table of so many rows: what loops over small tables takes is mostly tasks."""
    return max(1, min(shuffle_width(spark), max(6, rows // each)))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(left: DataFrame, right: DataFrame, key: str, salt: str, how: str = "left",
                max_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """Join a table whose ``key`` may be hot with one that has each key once.

    ``right`` is counted: up to ``max_rows`` rows it is broadcast; beyond that both sides are
    shuffled on (key, salt), the right one repeated ``salts`` times, so that a key with a third of
    the left rows still spreads over ``salts`` tasks. ``salt`` names a left column to spread by.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), key, how)
    left = left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")
