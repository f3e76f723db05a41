"""The shared folder and its tables."""

import os

from pyspark.sql import functions as F

from waymark.llm import shared


def test_tables_are_written_and_cleared(spark):
    df = shared.written(spark.range(5).withColumn("x", F.lit("a")), "numbers")
    folder = os.path.dirname(df.inputFiles()[0]).removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(folder)
    assert shared.scratch(spark) in "file://" + folder
    shared.clear(spark)
    assert not os.path.exists(folder)


def test_broadcasts_follow_a_count(spark):
    df = spark.range(3)
    assert "broadcast" in shared.small_or_plain(df, 3)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in shared.small_or_plain(df, 4, limit=3)._jdf.queryExecution().logical().toString().lower()
