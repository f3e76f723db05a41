"""Sinks of navigation documents: idempotent, partitioned by scene or split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import two_decimals
from ..operators.selection import parts_of


def by_scene(rows: DataFrame, path: str, overwrite: bool = False, keys: tuple[str, ...] = ("scene_id",), fmt: str = "parquet") -> None:
    """Writes rows in folders of their keys; fails if the path exists, unless only the partitions at hand are to be replaced."""
    w = rows.write.partitionBy(*keys).format(fmt)
    if overwrite:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        w.mode("errorifexists").save(path)


def written_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id) that the path has a folder of; none if it does not exist.  Contents are not read."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], "scene_id string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    scene = F.regexp_extract("path", r"/(?:scene_id|scene_name)=([^/]+)/", 1)
    return files.select(F.url_decode(F.replace(scene, F.lit("+"), F.lit("%2B"))).alias("scene_id")).where("scene_id <> ''").distinct()


def pending(rows: DataFrame, path: str, force: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of scenes that the path does not have yet, or of all by force; of the first so many of them."""
    rows = rows if force else rows.join(written_scenes(rows.sparkSession, path).withColumnRenamed("scene_id", "__done"), F.col("scene_id").cast("string") == F.col("__done"), "left_anti")
    if limit is None:
        return rows
    first = rows.select("scene_id").distinct().orderBy("scene_id").limit(limit)
    return rows.join(first, "scene_id", "left_semi")


def append(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("append").format(fmt).save(path)


def map_documents(instances: DataFrame) -> DataFrame:
    """(scene_id, value): the JSON document of each scene's instances, as grid.semantic_map() has them; metres are texts with two decimals."""

    @F.pandas_udf("array<string>")
    def shown(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [f"{a:.2f}" for a in v])

    @F.pandas_udf("array<array<string>>")
    def shown_pairs(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [[f"{a:.2f}" for a in pair] for pair in v])

    b = F.col("box")
    texts = instances.select(
        "scene_id", "category_id", F.col("label").alias("category_label"), "instance_id", "item_id", shown(b).alias("bbox_m"), shown(F.array(b[0], b[1], b[2] - b[0], b[3] - b[1])).alias("bbox_xywh_m"), "area",
        two_decimals(F.col("height")).alias("height_m"), two_decimals(F.col("z0")).alias("min_z_m"), two_decimals(F.col("z1")).alias("max_z_m"), shown_pairs("coords").alias("mask_coords_m"),
    )
    # objects, walls, unusable areas, as they are numbered
    kind = F.when(F.col("category_id") == -1, 2).when((F.col("category_label") == "wall") & F.col("instance_id").startswith("wall_"), 1).otherwise(0)
    number = F.regexp_extract("item_id", r"(\d+)$", 1).cast("long")
    body = F.sort_array(F.collect_list(F.struct(kind.alias("kind"), F.col("category_id").alias("c"), number.alias("k"), F.struct(*texts.columns[1:]).alias("o"))))
    return texts.groupBy("scene_id").agg(F.to_json(F.transform(body, lambda x: x["o"])).alias("value"))


def trajectory_documents(samples: DataFrame) -> DataFrame:
    """(scene_id, value): the JSON document of each scene's samples(scene_id, pos, trajectory_id, instructions, points).

    A document is one text, so a scene's samples meet in one row; sample_lines()
    has none of that size.
    """
    body = F.sort_array(F.collect_list(F.struct("pos", "trajectory_id", "instructions", "points")))
    bare = F.transform(body, lambda s: F.struct(s["trajectory_id"].alias("trajectory_id"), s["instructions"].alias("instructions"), s["points"].alias("points")))
    scenes = samples.groupBy("scene_id").agg(bare.alias("samples"))
    return scenes.select("scene_id", F.to_json(F.struct(F.array(F.struct("scene_id", F.col("scene_id").alias("scene_name"), "samples")).alias("scenes"))).alias("value"))


def sample_lines(samples: DataFrame) -> DataFrame:
    """(scene_id, value): one line of JSON for each of a scene's samples, for scenes of any size; readers.sample_lines() reads them."""
    return samples.select("scene_id", F.to_json(F.struct("scene_id", "pos", "trajectory_id", "instructions", "points")).alias("value"))


def texts_by_scene(rows: DataFrame, path: str, keys: tuple[str, ...] = ("scene_id",)) -> None:
    """One text file of value in the folder of each scene."""
    rows.select(*keys, "value").write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def split_files(selected: DataFrame, statistics: DataFrame, path: str) -> None:
    """The split mappings and their statistics, in folders of the splits."""
    selected.write.mode("overwrite").partitionBy("split").json(f"{path}/mappings")
    statistics.write.mode("overwrite").partitionBy("split").json(f"{path}/statistics")


def annotation_parts(samples: DataFrame, path: str, size: int = 10_000, order: list | None = None) -> DataFrame:
    """Writes parts of exactly size samples; returns the manifest (part, file, n)."""
    placed = parts_of(samples, size, order or [F.xxhash64("video_id", F.lit(42)), F.col("video_id")])
    named = placed.withColumn("file", F.concat(F.lit("annotations_part_"), F.lpad((F.col("part") + 1).cast("string"), 3, "0")))
    named.drop("place", "part").repartition("file").write.mode("overwrite").partitionBy("file").json(path)
    return named.groupBy("part", "file").agg(F.count("*").alias("n"))


def manifest(parts: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: totals of a dataset written in parts."""
    total = samples.agg(F.count("*").alias("samples"), F.count_distinct("video_id").alias("videos"))
    return parts.agg(F.count("*").alias("parts"), F.max("n").alias("largest"), F.array_sort(F.collect_list("file")).alias("files")).join(F.broadcast(total))


def renamed(file: Column, prefix: str) -> Column:
    """A file's name under a split's prefix in place of any other one."""
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(file, "^(train|val|test|trajectories_overall)_", ""))


def renamed_share(files: DataFrame, prefix: str) -> DataFrame:
    return files.agg(F.coalesce(F.avg(F.col("file").startswith(prefix + "_").cast("double")), F.lit(0.0)).alias("share"))


def measurements(rows: DataFrame, info: DataFrame, path: str) -> None:
    """The measures of each episode and what is known of it, in folders of scenes."""
    rows.join(info, "episode_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_name").json(path)


def summary(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)  # one row


def image_metadata(frames: DataFrame) -> DataFrame:
    """(scene_id, value): JSON of frames(scene_id, trajectory_id, instruction_index, pos, frame)."""
    each = frames.groupBy("scene_id", "trajectory_id", "instruction_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "frame"))), lambda x: x["frame"]).alias("frame_filenames"))
    each = each.withColumn("sampling_info", F.struct(F.size("frame_filenames").alias("generated_images_count")))
    return each.groupBy("scene_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("trajectory_id", "instruction_index", "frame_filenames", "sampling_info"))).alias("sequences"))).alias("value"))


def renumbered_pictures(files: DataFrame) -> DataFrame:
    """files(scene_id, part, trajectory_id, path) with the picture's new number and name over all parts."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("scene_id").orderBy("part", F.col("trajectory_id").cast("long"))) - 1
    return files.withColumn("number", place).withColumn("target", F.concat(F.lit("trajectory_"), F.col("number").cast("string"), F.lit("_vis.png")))


def without_pictures(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Trajectory files(scene_id, file) whose folder of pictures(scene_id, folder) does not exist."""
    own = files.withColumn("folder", F.concat(F.regexp_replace("file", r"\.json$", ""), F.lit("_visualizations")))
    return own.join(folders, ["scene_id", "folder"], "left_anti")
