"""The stages of a small dataset, from files to files."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import __main__ as cli
from waymark import stages
from waymark.sources import readers


def corner(x, y, z):
    return {"x": x, "y": y, "z": z}


@pytest.fixture
def data(tmp_path):
    for k in range(6):
        scene = tmp_path / "raw" / f"{k:04d}_{k:06d}"
        scene.mkdir(parents=True)
        box = [corner(x, y, z) for z in (0, 1) for x, y in ((0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.0, 0.2))]
        (scene / "labels.json").write_text(json.dumps([{"label": "Chair", "bounding_box": box}, {"label": "lamp"}]))
        (scene / "occupancy.json").write_text(json.dumps({"scale": 0.1, "min": [0, 0, 0]}))
        (scene / "occupancy.pgm").write_bytes(b"P5 4 3 255\n" + bytes([0] * 4 + [255] * 4 + [100] * 4))
        folder = tmp_path / "paths" / f"{k:06d}"
        folder.mkdir(parents=True)
        for part in ("", "_part2"):
            samples = [
                {"trajectory_id": str(t), "instructions": [{"instruction_type": "Area-based", "start": "a_1", "end": "b_1", "generated_instruction": f"go {t}"}, "bare words"],
                 "points": [{"point": str(i), "position": [0.3 * i, 0.1 * t, 0.5], "rotation": [-math.sin(0.1 * i), 0, 0, math.cos(0.1 * i)]} for i in range(4 + t)]}
                for t in range(3)
            ]
            (folder / f"trajectories_0001_{k:06d}{part}_trans.json").write_text(json.dumps({"scenes": [{"scene_id": "0", "scene_name": f"{k:06d}", "samples": samples}]}))
    (tmp_path / "types.json").write_text(json.dumps([{"world_id": 1, "design_type": "Shop"}]))
    return tmp_path


def test_maps(spark, data):
    stages.physical_map(spark, f"{data}/raw/*/labels.json", f"{data}/physical")
    rows = spark.read.json(f"{data}/physical").collect()
    assert len(rows) == 6 and {(r.key, r.bounds) for r in rows} == {("Chair_1", "(0.00,0.00,0.00),(0.20,0.20,1.00)")}
    stages.semantic_map(spark, f"{data}/raw/*/labels.json", f"{data}/raw/*/occupancy.pgm", f"{data}/raw/*/occupancy.json", f"{data}/semantic")
    items = spark.read.json(f"{data}/semantic").groupBy("item_id").count().collect()
    assert {(r.item_id, r["count"]) for r in items} == {("chair_1", 6), ("wall_1", 6)}


def test_dataset(spark, data):
    stages.merge(spark, f"{data}/paths", f"{data}/merged")
    stages.statistics(spark, f"{data}/merged", f"{data}/statistics")
    scenes = spark.read.json(f"{data}/statistics/scenes").collect()
    assert len(scenes) == 6 and {(r.n, r.total_instructions, r.unique_pairs) for r in scenes} == {(6, 12, 1)}
    stages.split(spark, f"{data}/merged", f"{data}/types.json", f"{data}/splits", val=1, unseen=1, target=6, scenes=2)
    m = spark.read.json(f"{data}/splits/mappings")
    assert {r.split for r in m.select("split").distinct().collect()} == {"val", "scene_unseen", "trajectory_unseen", "instruction_unseen", "train"}
    assert m.agg(F.sum("instruction_count")).first()[0] == 72
    stages.extract(spark, f"{data}/merged", f"{data}/splits", f"{data}/extracted")
    docs = readers.documents(spark, f"{data}/extracted", recursive=True)
    split = F.regexp_extract("path", "/split=([^/]+)/", 1)
    found = docs.select(split.alias("split"), F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"), F.from_json("value", "struct<scenes:array<struct<scene_id:string,samples:array<struct<trajectory_id:string,instructions:array<string>>>>>>")["scenes"][0].alias("s")).select("split", "file", "s.*").collect()
    assert {(r.split, r.file) for r in found} == {(k, f"{v}_trajectories") for k, v in stages.PREFIXES.items()}
    # every instruction lies in one split, and the splits are those of the mapping
    each = [(r.scene_id, x.trajectory_id, i) for r in found for x in r.samples for i in x.instructions]
    assert len(each) == len(set(each)) == 72
    per = {}
    for r in found:
        for x in r.samples:
            per[r.split, r.scene_id.zfill(6), x.trajectory_id] = len(x.instructions)
    assert per == {(r.split, str(r.scene_id).zfill(6), str(r.trajectory_id)): r.instruction_count for r in m.collect()}
    stages.actions(spark, f"{data}/merged", f"{data}/actions")
    a = spark.read.json(f"{data}/actions").collect()
    assert len(a) == 72 and all(len(r.actions) == len(r.poses) and r.actions[-1] == "STOP" for r in a)
    frames = spark.createDataFrame([(r.scene_id, r.trajectory_id, r.instruction_index, k, f"f{k}.png", k != 3) for r in a for k in range(len(r.actions))], "scene_id string, trajectory_id string, instruction_index int, pos int, frame string, there boolean")
    a0 = spark.read.json(f"{data}/actions").schema["scene_id"].dataType.simpleString()
    frames = frames.withColumn("scene_id", F.col("scene_id").cast(a0))
    manifest = stages.training_parts(spark.read.json(f"{data}/actions"), frames, f"{data}/training", 50).first()
    n = sum(min(3, len(r.actions)) for r in a)
    assert (manifest.samples, manifest.videos, manifest.parts) == (n, 72, -(-n // 50))


def test_trajectories_from_labels_and_images(spark, tmp_path):
    """A room with a wall across it but for a door; objects on both sides."""
    h, w = 40, 60
    image = np.full((h, w), 255, np.uint8)
    image[:, 30] = 100
    image[18:22, 30] = 255
    scene = tmp_path / "raw" / "0001_a"
    scene.mkdir(parents=True)
    box = lambda x, y: [corner(a, b, z) for z in (0, 1) for a, b in ((x, y), (x + 0.4, y), (x + 0.4, y + 0.4), (x, y + 0.4))]
    places = {"Chair": (0.3, 0.3), "Lamp": (5.0, 3.2), "Door": (2.0, 2.0), "Sofa": (3.9, 0.4)}
    (scene / "labels.json").write_text(json.dumps([{"label": k, "bounding_box": box(*v)} for k, v in places.items()] + [{"label": "ghost"}]))
    (scene / "occupancy.json").write_text(json.dumps({"scale": 0.1, "min": [0, 0, 0]}))
    (scene / "occupancy.pgm").write_bytes(b"P5 60 40 255\n" + image.tobytes())
    raw, maps, out = f"{tmp_path}/raw/*", f"{tmp_path}/maps", f"{tmp_path}/out"
    stages.semantic_map(spark, f"{raw}/labels.json", f"{raw}/occupancy.pgm", f"{raw}/occupancy.json", maps)
    found = stages.instances(spark, f"{maps}/*")
    items = {r.item_id for r in found.collect()}
    assert {"chair_1", "lamp_1", "door_1", "sofa_1", "wall_1"} <= items and "ghost_1" not in items
    all_pairs = spark.createDataFrame([("0001_a", a, b) for a in ("chair_1", "lamp_1") for b in ("lamp_1", "chair_1", "ghost_1") if a != b], "scene_id string, start string, end string")
    walks = {(r.start, r.end): r.points for r in stages.paths_of(all_pairs, found, radius=0.1, scale=0.1).collect()}
    assert set(walks) == {("chair_1", "lamp_1"), ("lamp_1", "chair_1")}
    for points in walks.values():
        at = [p.position for p in points]
        assert all(math.dist(a[:2], b[:2]) <= 0.15 for a, b in zip(at, at[1:], strict=False)) and {p[2] for p in at} == {0.5}
        assert points[0].rotation[3] == pytest.approx(math.cos(math.atan2(at[1][1] - at[0][1], at[1][0] - at[0][0]) / 2))
    stages.trajectories(spark, f"{raw}/labels.json", f"{maps}/*", out)
    first = readers.trajectories(spark, out)
    got = first.select("scene_id", "trajectory_id", F.size("points").alias("n"), "instructions").collect()
    judged = [(a, b) for a in places for b in places if a != b]
    assert 0 < len(got) <= len(judged) and {r.scene_id for r in got} == {"0001_a"} and [r.trajectory_id for r in sorted(got, key=lambda r: int(r.trajectory_id))] == [str(k) for k in range(len(got))]
    told = readers.instructions(first).select("start", "end", "text").collect()
    assert all(r.start != r.end and {r.start, r.end} <= items for r in told) and all("from" in r.text.lower() for r in told)
    stages.trajectories(spark, f"{raw}/labels.json", f"{maps}/*", f"{tmp_path}/again", existing=out)
    assert readers.trajectories(spark, f"{tmp_path}/again").count() == 0
    stages.trajectories(spark, f"{raw}/labels.json", f"{maps}/*", f"{tmp_path}/few", budget=1, bad=["a"])
    assert readers.trajectories(spark, f"{tmp_path}/few").count() == 0
    stages.to_scene(spark, out, f"{maps}/*", f"{tmp_path}/scene")
    assert readers.trajectories(spark, f"{tmp_path}/scene").count() == len(got)
    stages.scene_text(spark, f"{maps}/*", f"{tmp_path}/texts")
    assert readers.documents(spark, f"{tmp_path}/texts/*").first().value.startswith("I see")
    (tmp_path / "template.txt").write_text("a {scene} b\n")
    (tmp_path / "usd").mkdir()
    for name in ("0042.usdz", "x1.usdz"):
        (tmp_path / "usd" / name).write_text("x")
    stages.scene_files(spark, f"{tmp_path}/template.txt", f"{tmp_path}/usd", f"{tmp_path}/filled")
    filled = readers.documents(spark, f"{tmp_path}/filled/*").collect()
    assert [(r.scene_id, r.value.strip()) for r in filled] == [("0042", "a 0042 b")]


def test_done_scenes_are_left_out(spark, data):
    stages.physical_map(spark, f"{data}/raw/*/labels.json", f"{data}/physical", limit=2)
    assert spark.read.json(f"{data}/physical").select("scene_id").distinct().count() == 2
    before = {p: p.stat().st_mtime_ns for p in (data / "physical").rglob("part-*")}
    stages.physical_map(spark, f"{data}/raw/*/labels.json", f"{data}/physical")
    assert spark.read.json(f"{data}/physical").count() == 6 and all(p.stat().st_mtime_ns == t for p, t in before.items())
    stages.physical_map(spark, f"{data}/raw/*/labels.json", f"{data}/physical", overwrite=True)
    assert spark.read.json(f"{data}/physical").count() == 6 and not any(p.exists() for p in before)


def test_pictures_and_training(spark, data):
    stages.merge(spark, f"{data}/paths", f"{data}/merged", only=["000001"])
    stages.actions(spark, f"{data}/merged", f"{data}/actions", limit=2)
    a = spark.read.json(f"{data}/actions").orderBy("trajectory_id", "instruction_index").collect()
    assert len(a) == 4
    for r in a[:3]:
        folder = data / "pictures" / str(r.scene_id) / f"{r.trajectory_id}_{r.instruction_index}"
        folder.mkdir(parents=True)
        for k in range(len(r.actions) - (r is a[2])):
            (folder / f"frame_{k:04d}.png").write_text("x")
    left = stages.images(spark, f"{data}/actions", f"{data}/pictures", f"{data}/metadata").collect()
    assert [(r.trajectory_id, r.images) for r in left] == [(str(a[2].trajectory_id), len(a[2].actions) - 1)]
    sequences = json.loads(readers.documents(spark, f"{data}/metadata/*").first().value)["sequences"]
    assert [len(x["frame_filenames"]) for x in sequences] == [len(r.actions) - (r is a[2]) for r in a[:3]]
    manifest = stages.training(spark, f"{data}/actions", f"{data}/pictures", f"{data}/training", 5).first()
    n = sum(len(r.actions) for r in a[:3]) - 1
    assert (manifest.samples, manifest.videos, manifest.parts) == (n, 3, -(-n // 5))


def test_evaluation_resumes(spark, data):
    stages.episode_files(spark, f"{data}/paths", f"{data}/episodes", 0.5, "*0001_000001_trans.json")
    e = spark.read.json(f"{data}/episodes")
    assert e.count() == 6
    s = e.select("episode_id", F.posexplode("reference_path").alias("seq", "p")).select("episode_id", "seq", F.col("seq").cast("double").alias("t"), *(F.col("p")[k].alias(c) for k, c in enumerate("xyz")), F.lit(False).alias("collided"))
    s.write.parquet(f"{data}/steps")
    stages.evaluate(spark, f"{data}/steps", f"{data}/episodes", f"{data}/measured")
    got = spark.read.json(f"{data}/measured").collect()
    assert len(got) == 6 and all(r.success == 1 and r.spl == pytest.approx(1) for r in got)
    stages.evaluate(spark, f"{data}/steps", f"{data}/episodes", f"{data}/measured")
    assert spark.read.json(f"{data}/measured").count() == 6


def test_command_line():
    args = cli.parser().parse_args(["split", "--trajectories", "a", "--types", "b", "--out", "c", "--val", "3"])
    assert (args.val, args.unseen, args.stage) == (3, 15, "split")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["actions", "--out", "x"])
    args = cli.parser().parse_args(["to-scene", "--trajectories", "a", "--maps", "b", "--out", "c", "--no-flip-x", "--force", "--only", "1", "2"])
    assert (args.no_flip_x, args.no_flip_y, args.only, args.force) == (True, False, ["1", "2"], True)
    args = cli.parser().parse_args(["images", "--actions-path", "a", "--pictures", "b", "--out", "c", "--limit", "7", "--shards", "3"])
    assert (args.limit, args.shards, args.shard) == (7, 3, 0) and len(cli.STAGES) == 15


def test_exports():
    import waymark

    assert all(getattr(waymark, n) is not None for n in waymark.__all__)
    with pytest.raises(AttributeError):
        _ = waymark.nothing
