"""Readers of navigation documents.  A scene is a folder; paths may be globs on any file system that Spark reads."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised_instruction
from ..operators.joins import contiguous_parts, first_by_pattern, next_part
from . import schemas

#: Names of trajectory files, the preferred first.
TRAJECTORY_FILES = [r"^train_.*\.json$", r"^val_.*\.json$", r"^test_.*\.json$", r"^trajectories_overall_.*\.json$", r"\.json$"]


def folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decoded(part: Column) -> Column:
    """A part of a path that Spark has written or names, as it was."""
    return F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, scene_id, file, bytes) of files; scene_id is their folder.  Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", folder(F.col("path")).alias("scene_id"), name(F.col("path")).alias("file"), F.col("length").alias("bytes"))


def scene_files(spark: SparkSession, root: str, file: str, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """files() of one name in all scenes, sorted, of some scenes, the first of them."""
    rows = files(spark, f"{root}/*", file)
    rows = rows if only is None else rows.where(F.col("scene_id").isin(only))
    rows = rows.orderBy("scene_id")
    return rows if limit is None else rows.limit(limit)


def documents(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, scene_id, file, value) of whole text files."""
    reader = spark.read.option("wholetext", "true").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    own = F.input_file_name()
    # folders may be those that a stage writes, whose names are encoded
    scene = F.when(folder(own).startswith("scene_id="), decoded(decoded(F.substring(folder(own), 10, 10_000)))).otherwise(decoded(folder(own)))
    return reader.text(path).select(own.alias("path"), scene.alias("scene_id"), decoded(name(own)).alias("file"), "value")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, pos, label, ins_id, bounding_box) of annotations, a list or an object with the key labels."""
    listed = F.from_json("value", schemas.LABELS)
    keyed = F.from_json("value", f"struct<labels:{schemas.LABELS}>")["labels"]
    is_list = F.ltrim("value").startswith("[")
    found = documents(spark, path).select("scene_id", F.posexplode(F.when(is_list, listed).otherwise(keyed)).alias("pos", "o"))
    return found.select("scene_id", "pos", "o.*")


def semantic_map(spark: SparkSession, path: str) -> DataFrame:
    """Instances with their place in the file; numbers stay texts, see numbers().  Folders may be those the stage writes."""
    struct = F.from_json("value", f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _fields(schemas.INSTANCE))}>>")
    scene = F.regexp_replace("scene_id", "^scene_id=", "").alias("scene_id")
    return documents(spark, path).select(scene, F.posexplode(struct).alias("pos", "o")).select("scene_id", "pos", "o.*")


def _fields(ddl: str) -> list[str]:
    out, depth, own = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(own)
            own = ""
        else:
            own += ch
    return [*out, own]


def numbers(texts: Column) -> Column:
    """array<double> of an array of texts; null for those that are no numbers."""
    return F.transform(texts, lambda x: x.try_cast("double"))


def trajectories(spark: SparkSession, path: str, pattern: str | None = None, all_scenes: bool = False) -> DataFrame:
    """(path, scene_id, scene_name, pos, trajectory_id, instructions, points) of the first scene of each document, or of all.

    Broken documents give no row.
    """
    doc = F.from_json("value", f"struct<{schemas.TRAJECTORIES.replace('dataset_metadata ', 'dataset_metadata:').replace('scenes ', 'scenes:')}>")
    rows = documents(spark, path, pattern, recursive=True).select("path", "scene_id", doc["scenes"].alias("scenes"))
    scenes = rows.select("path", F.col("scene_id").alias("folder"), F.explode("scenes" if all_scenes else F.slice("scenes", 1, 1)).alias("s"))
    found = scenes.select("path", F.coalesce("s.scene_name", "folder").alias("scene_id"), "s.scene_name", F.posexplode("s.samples").alias("pos", "x"))
    return found.select("path", "scene_id", "scene_name", "pos", "x.*")


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, pos, trajectory_id, instructions, points) of lines as writers.sample_lines() has them."""
    schema = f"scene_id:string,pos:bigint,{schemas.SAMPLE.removeprefix('struct<').removesuffix('>')}"
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    return rows.select(F.from_json("value", f"struct<{schema}>").alias("x")).where("x is not null").select("x.*")


def points(samples: DataFrame) -> DataFrame:
    """(scene_id, trajectory_id, seq, x, y, z, qx, qy, qz, qw)."""
    p = samples.select("scene_id", "trajectory_id", F.posexplode("points").alias("seq", "p"))
    axes = [F.get("p.position", F.lit(k)).alias(a) for k, a in enumerate("xyz")] + [F.get("p.rotation", F.lit(k)).alias(f"q{a}") for k, a in enumerate("xyzw")]
    return p.select("scene_id", "trajectory_id", "seq", *axes)


def instructions(samples: DataFrame) -> DataFrame:
    """(scene_id, trajectory_id, instruction_index, instruction_type, start, end, text)."""
    i = samples.select("scene_id", "trajectory_id", F.posexplode("instructions").alias("instruction_index", "raw"))
    n = i.withColumn("n", normalised_instruction(F.col("raw")))
    return n.select("scene_id", "trajectory_id", "instruction_index", "n.instruction_type", "n.start", "n.end", F.col("n.generated_instruction").alias("text"))


def preferred_files(rows: DataFrame) -> DataFrame:
    """Of files() the one of each scene whose name comes first in TRAJECTORY_FILES, by name among equals."""
    best = first_by_pattern(rows, TRAJECTORY_FILES).where(F.col("rank") < len(TRAJECTORY_FILES))
    return best.groupBy("scene_id").agg(F.min_by(F.struct("path", "file"), "file").alias("x")).select("scene_id", "x.*")


def test_files(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root, "test_*.json", recursive=True)


def existing_trajectories(samples: DataFrame) -> DataFrame:
    """(scene_id, n) of trajectories() in the parts from the first on up to a gap."""
    from ..functions.text import part_number

    part = samples.withColumn("part", part_number(F.col("path")))
    per = part.groupBy("scene_id", "part").agg(F.count("*").alias("n"))
    return contiguous_parts(per).groupBy("scene_id").agg(F.sum("n").alias("n"))


def free_part(samples: DataFrame) -> DataFrame:
    from ..functions.text import part_number

    return next_part(samples.select("scene_id", part_number(F.col("path")).alias("part")).distinct())


def scene_types(spark: SparkSession, path: str) -> DataFrame:
    rows = documents(spark, path).select(F.explode(F.from_json("value", "array<struct<world_id:int,design_type:string>>")).alias("x"))
    return rows.select("x.*")


def mappings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(split, scene_id, trajectory_id, instruction_count, selected, available) of split mappings; fails if a file is missing."""
    out = None
    for split, path in paths.items():
        m = spark.read.schema(schemas.MAPPING).option("multiLine", "true").option("mode", "FAILFAST").json(path)
        one = m.select(F.lit(split).alias("split"), F.explode("scenes").alias("scene_id", "s")).select("split", "scene_id", F.explode_outer("s.trajectories").alias("t"))
        one = one.select("split", "scene_id", "t.trajectory_id", "t.instruction_count", F.col("t.selected_instruction_indices").alias("selected"), F.col("t.available_instruction_indices").alias("available"))
        out = one if out is None else out.unionByName(one)
    return out


def ground_truth(spark: SparkSession, path: str, key: str = "groundtruth_data", schema: str = schemas.ACTIONS) -> DataFrame:
    """Rows of the list under a key of documents: action ground truth, or image sequences under "sequences"."""
    item = ", ".join(f"{f.strip().split(' ', 1)[0]}:{f.strip().split(' ', 1)[1]}" for f in _fields(schema))
    doc = F.from_json("value", f"struct<{key}:array<struct<{item}>>>")
    rows = documents(spark, path, recursive=True).select(F.col("scene_id").alias("folder"), F.posexplode(doc[key]).alias("pos", "x"))
    return rows.select("pos", *(F.coalesce("x.scene_id", "folder").alias(c) if c == "scene_id" else F.col(f"x.{c}") for c in [f.strip().split(" ", 1)[0] for f in _fields(schema)]))


def images(spark: SparkSession, path: str) -> DataFrame:
    return ground_truth(spark, path, "sequences", schemas.IMAGES)


def scene_texts(scenes: DataFrame, texts: DataFrame) -> DataFrame:
    """scenes(scene_id, ...) with text; empty without one."""
    return scenes.join(texts.select("scene_id", F.col("value").alias("text")), "scene_id", "left").fillna("", ["text"])


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(path, role, content) of prompt templates, in order."""
    rows = documents(spark, path).select("path", F.posexplode(F.from_json("value", "array<struct<role:string,content:string>>")).alias("pos", "m"))
    return rows.orderBy("path", "pos").select("path", "m.role", "m.content")


def numbered_files(rows: DataFrame) -> DataFrame:
    """Of files() those whose stem is all digits."""
    return rows.withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", "")).where(F.col("stem").rlike("^[0-9]+$"))


def scene_name(rows: DataFrame) -> DataFrame:
    return rows.withColumn("scene_name", F.get_json_object("value", "$.scenes[0].scene_name"))


def _gray(raw: bytes) -> np.ndarray:
    """Pixels of a binary PGM image (P5, 8 bit), or of any other that an installed imaging library opens."""
    if raw[:2] == b"P5":
        head, at = [], 2
        while len(head) < 3:
            while raw[at : at + 1].isspace():
                at += 1
            if raw[at : at + 1] == b"#":
                at = raw.index(b"\n", at)
                continue
            end = at
            while not raw[end : end + 1].isspace():
                end += 1
            head.append(int(raw[at:end]))
            at = end
        return np.frombuffer(raw, np.uint8, head[0] * head[1], at + 1).reshape(head[1], head[0])
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(raw)).convert("L"))


def occupancy(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, row, col, v) of grayscale images."""
    rows = spark.read.format("binaryFile").load(path).select(folder(F.col("path")).alias("scene_id"), "content")

    def run(batches):
        for batch in batches:
            for scene, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = _gray(raw)
                r, c = np.indices(g.shape)
                yield pa.RecordBatch.from_arrays([pa.array([scene] * g.size), pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(g.ravel(), pa.int32())], names=["scene_id", "row", "col", "v"])

    return rows.mapInArrow(run, "scene_id string, row int, col int, v int")


def occupancy_meta(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, scale, x0, y0)."""
    m = F.from_json("value", "struct<scale:double,min:array<double>>")
    return documents(spark, path).select("scene_id", m["scale"].alias("scale"), F.get(m["min"], F.lit(0)).alias("x0"), F.get(m["min"], F.lit(1)).alias("y0"))
