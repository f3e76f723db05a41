"""Raw annotations of scenes: physical maps and checks of candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import corners_box
from ..functions.text import bounds_text, label_or_unknown
from .selection import shuffled_order


def physical_map(labels: DataFrame) -> DataFrame:
    """(scene_id, pos, key, box, bounds) of labels(scene_id, pos, label, bounding_box): each object's extent under "label_k".

    Objects without a list of corners are skipped before they are counted, those
    whose corners make no box after, which leaves a gap in the numbers.
    """
    listed = labels.where(F.col("bounding_box").isNotNull()).withColumn("label", label_or_unknown(F.col("label")))
    place = F.row_number().over(Window.partitionBy("scene_id", "label").orderBy("pos"))
    keyed = listed.withColumn("key", F.concat_ws("_", "label", place.cast("string"))).withColumn("box", corners_box(F.col("bounding_box")))
    return keyed.where(F.col("box").isNotNull()).select("scene_id", "pos", "key", "box", bounds_text(F.col("box")).alias("bounds"))


def skipped_labels(labels: DataFrame) -> DataFrame:
    """(scene_id, labels, skipped): how many have no box."""
    bad = corners_box(F.col("bounding_box")).isNull()
    return labels.groupBy("scene_id").agg(F.count("*").alias("labels"), F.count_if(bad).alias("skipped"))


def budgeted_pairs(pairs: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """At most budget of each scene's pairs(scene_id, start, end), in a stable random order."""
    w = Window.partitionBy("scene_id").orderBy(shuffled_order("start", "end", seed=seed), "start", "end")
    return pairs.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= budget).drop("__i")


def duplicate_pairs(pairs: DataFrame, warn_below: float = 0.9) -> DataFrame:
    """(scene_id, pairs, distinct_pairs, ratio, warned): the share of pairs that differ."""
    n = pairs.groupBy("scene_id").agg(F.count("*").alias("pairs"), F.count_distinct("start", "end").alias("distinct_pairs"))
    return n.withColumn("ratio", F.col("distinct_pairs") / F.col("pairs")).withColumn("warned", F.col("ratio") < warn_below)
