"""Written tables, size-checked broadcasts, Arrow batches and columns under safe names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clear, fresh_path, native_given_back, scratch, shared_dir, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "BROADCAST_ROWS", "Columns", "clear", "fresh_path", "heap_given_back", "scratch", "shared_dir", "small_batches", "small_or_plain", "written"]

#: A side with at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 1_000_000

#: Texts, and bytes, that go to Python at once; a longer text goes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 256 << 10


def small_batches(df: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """df, after the session's Arrow batches are held to so many rows and bytes, as texts may be long.

    Memory outside of the heap, which executors don't give back, grows with the
    largest batches.  The settings are the session's; they can't be had for one
    plan alone.
    """
    conf = df.sparkSession.conf
    for key, most, unset in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, "64m")):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key, unset)
        n = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(now)) if key.endswith("BytesPerBatch") else int(now)
        if n > most or n <= 0:
            conf.set(key, str(most))
    return df


def small_or_plain(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the limit."""
    return F.broadcast(df) if rows <= limit else df


def heap_given_back(spark: SparkSession) -> None:
    """Has executors and the driver collect garbage, so that the heap that earlier work left empty goes back to the system.

    Else it stays, and memory that later work takes outside of the heap comes on
    top.  Short tasks, a few for each core, reach all executors that are idle; one
    that none of them reaches keeps its heap and loses nothing.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
    spark._jvm.System.gc()
    native_given_back(spark)


class Columns:
    """The columns of a table under names of our own, so that none of a caller's can clash with one of ours."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.own = {c: f"__own_{k}" for k, c in enumerate(self.names)}
        self.df = df.toDF(*self.own.values())

    def __getitem__(self, name: str) -> str:
        return self.own[name]

    def back(self, df: DataFrame, **new: str) -> DataFrame:
        """The caller's columns of df under their names; new: columns of ours that replace one."""
        return df.select(*(F.col(new.get(c, self.own[c])).alias(c) for c in self.names))
