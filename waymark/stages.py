"""The stages of building and evaluating a dataset, from files to files.

Each stage takes a session, the paths it reads and writes, and its options.
``python -m waymark STAGE --help`` runs one from the command line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.geometry import scene_poses
from .functions.text import checked_template, normalised_label, part_number, tail_id
from .operators import actions as act
from .operators import adapters, annotations, clients, episodes, grid, joins, measures, selection, stats
from .scratch import written
from .sources import readers, writers

#: Height of a camera, path cells from one pose to the next, the camera's settings, prefixes of splits' files.
FIXED_Z, SAMPLE_STEP = 0.5, 1
CAMERA = {"focal_length": 7.0, "horizontal_aperture": 20.954999923706055, "vertical_aperture": 20.954999923706055, "focus_distance": 0.0}
CLIPPING = [1.0, 1000000.0]
PREFIXES = {"train": "train", "val": "val", "scene_unseen": "test", "trajectory_unseen": "test", "instruction_unseen": "test"}


def _some(rows: DataFrame, only: list[str] | None) -> DataFrame:
    return rows if not only else rows.where(F.col("scene_id").isin(only))


def _todo(rows: DataFrame, out: str, only: list[str] | None, force: bool, limit: int | None) -> DataFrame:
    """Rows of the scenes that a stage is to do: some by name, those not done yet unless by force, the first of them."""
    return writers.pending(_some(rows, only), out, force, limit)


def _client(api_url: str | None, model: str, api_key: str, temperature: float = 0.2) -> Callable[[], object]:
    """A chat server's client, or without a URL the one that answers by rule."""
    return adapters.FakeClient if not api_url else lambda: clients.ChatClient(api_url, model, api_key, temperature)


def physical_map(spark: SparkSession, labels: str, out: str, only: list[str] | None = None, overwrite: bool = False, limit: int | None = None) -> None:
    """Extents of all annotated objects, one folder a scene; scenes that are done are left out unless overwritten."""
    rows = _todo(readers.labels(spark, labels), out, only, overwrite, limit)
    writers.by_scene(annotations.physical_map(rows).select("scene_id", "key", "bounds"), out, True, fmt="json")


def semantic_map(spark: SparkSession, labels: str, images: str, meta: str, out: str, only: list[str] | None = None, overwrite: bool = False, max_scenes: int | None = None) -> None:
    """Instances with their boxes and masks on the ground, walls and unusable areas, one document a scene; scenes that are done are left out unless overwritten."""
    scenes = _todo(readers.files(spark, images).select("scene_id").distinct(), out, only, overwrite, max_scenes)
    image = readers.occupancy(spark, images).join(scenes, "scene_id", "left_semi")
    size = image.groupBy("scene_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    extent = readers.occupancy_meta(spark, meta).join(size, "scene_id")
    named = readers.labels(spark, labels).join(scenes, "scene_id", "left_semi")
    o = named.where(F.size("bounding_box") >= 4)
    ring = F.transform(F.slice("bounding_box", 1, 4), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    z = F.transform("bounding_box", lambda p: p["z"])
    objects = o.select("scene_id", "pos", "label", "ins_id", ring.alias("ring"), F.array_min(z).alias("z0"), F.array_max(z).alias("z1"))
    writers.by_scene(writers.map_documents(grid.semantic_map(objects, image, extent, named)), out, True, fmt="text")


def scene_text(spark: SparkSession, maps: str, out: str, prompt: str = "Describe the scene that these objects make up.", api_url: str | None = None, model: str = "", api_key: str = "", temperature: float = 0.2, retries: int = 5, only: list[str] | None = None, force: bool = False, limit: int | None = None) -> None:
    """A model's description of each scene from its objects and their boxes, one text a scene; scenes that are done are left out."""
    m = _todo(readers.semantic_map(spark, maps), out, only, force, limit)
    items = m.groupBy("scene_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("item_id", "bbox_m", "height_m")))).alias("items"))
    rows = items.select("scene_id", F.to_json(F.array(adapters.message("system", F.lit(prompt)), adapters.message("user", F.concat(F.lit("Objects: "), F.col("items"))))).alias("messages"))
    got = adapters.asked(rows, _client(api_url, model, api_key, temperature), retries=retries)
    writers.texts_by_scene(got.where("answer is not null").select("scene_id", F.col("answer").alias("value")), out)


def instances(spark: SparkSession, maps: str) -> DataFrame:
    """(scene_id, pos, item_id, label, coords) of map documents, coords as numbers."""
    m = readers.semantic_map(spark, maps)
    return m.select("scene_id", "pos", "item_id", F.col("category_label").alias("label"), F.transform("mask_coords_m", lambda c: readers.numbers(c)).alias("coords"))


def paths_of(pairs: DataFrame, found: DataFrame, radius: float = grid.PLANNER_RADIUS, scale: float = 0.05, every: int = SAMPLE_STEP, z: float = FIXED_Z) -> DataFrame:
    """pairs(scene_id, start, end) with points, the poses of a path from one of instances() to the other; pairs without a path go.

    Masks become cells, walls and unusable areas widen to obstacles, and the cells
    of the shortest path become every so many positions that look to the next one.
    """
    extent = grid.map_extent(found, scale)
    cells = grid.mask_cells(found, extent)
    masks = cells.groupBy("scene_id", "item_id").agg(F.sort_array(F.collect_list(F.struct("row", "col"))).alias("mask"))
    requests = pairs.select("scene_id", "start", "end", F.struct("start", "end").alias("pair")).withColumn("pair_id", F.to_json("pair")).drop("pair")
    for side in ("start", "end"):
        requests = requests.join(masks.select("scene_id", F.col("item_id").alias(side), F.col("mask").alias(f"{side}_mask")), ["scene_id", side])
    asked = requests.select("scene_id", "pair_id", F.col("start_mask").alias("start"), F.col("end_mask").alias("goal"))
    planned = grid.planned_paths(asked, grid.obstacle_cells(found, extent, radius, scale), extent).where("cost is not null")
    placed = planned.join(extent.select("scene_id", "x0", "y0"), "scene_id")
    spots = F.filter("cells", lambda c, i: i % every == 0)
    at = F.transform(spots, lambda c: F.struct((F.col("x0") + (c["col"] + 0.5) * scale).alias("x"), (F.col("y0") + (c["row"] + 0.5) * scale).alias("y")))
    ahead = F.concat(F.slice(at, 2, F.size(at)), F.slice(at, F.size(at), F.lit(1)))
    legs = F.zip_with(at, ahead, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), F.atan2(b["y"] - a["y"], b["x"] - a["x"]).alias("yaw")))

    def pose(p: Column, i: Column) -> Column:
        rest = [F.lit(v).alias(k) for k, v in CAMERA.items()]
        none = F.array().cast("array<string>")
        clip = F.array(*(F.lit(v) for v in CLIPPING)).alias("clipping_range")
        turn = F.array(F.lit(0.0), F.lit(0.0), F.sin(p["yaw"] / 2), F.cos(p["yaw"] / 2)).alias("rotation")
        return F.struct(i.cast("string").alias("point"), F.array(p["x"], p["y"], F.lit(z)).alias("position"), turn, none.alias("action"), none.alias("camera_images"), *rest, clip)

    pairs_of = requests.select("scene_id", "pair_id", "start", "end")
    return placed.withColumn("points", F.transform(legs, pose)).join(pairs_of, ["scene_id", "pair_id"]).select("scene_id", "start", "end", "points")


def trajectories(spark: SparkSession, labels: str, maps: str, out: str, existing: str | None = None, texts: str | None = None, bad: list[str] | None = None, budget: int = 5000, judge_prompt: str = "Which pairs make sense as the start and end of a walk?", prompt: str = "Write instructions for a walk from start to end.", api_url: str | None = None, model: str = "", api_key: str = "", limit: int = adapters.LIMIT, only: list[str] | None = None) -> None:
    """Trajectories with instructions between labelled objects: pairs within reach, judged by a model, with a path, told by a model.

    Objects must be in the scene's map.  Pairs that existing trajectories have
    are left out, and the new ones go to the next part of their scene.
    """
    named = _some(readers.labels(spark, labels), only).where("label <> ''")
    if bad:
        named = named.where(~tail_id(F.col("scene_id")).isin(bad))
    items = stats.numbered_labels(named, normalised_label(F.col("label")), ["scene_id"], ["pos"]).select("scene_id", "item_id", "label")
    found = instances(spark, maps)
    spots = found.select("scene_id", "item_id", F.explode("coords").alias("c")).groupBy("scene_id", "item_id").agg(F.avg(F.col("c")[1]).alias("x"), F.avg(F.col("c")[0]).alias("y"))
    candidates = items.join(spots, ["scene_id", "item_id"])  # those that the map has
    pairs = joins.candidate_pairs(candidates).select("scene_id", "start", "end")
    old = None
    if existing:
        old = readers.trajectories(spark, existing)
        pairs = pairs.join(readers.instructions(old).select("scene_id", "start", "end").distinct(), ["scene_id", "start", "end"], "left_anti")
    pairs = annotations.budgeted_pairs(pairs, budget)
    factory = _client(api_url, model, api_key)
    scene = readers.documents(spark, texts).select("scene_id", F.col("value").alias("text")) if texts else None
    judged = written(adapters.judged(pairs, factory, judge_prompt, scene).where("meaningful").select("scene_id", "start", "end"), "judged")
    walks = written(paths_of(judged, found), "walks")
    told = adapters.instructed(walks.select("scene_id", "start", "end"), factory, prompt, limit=limit)
    told = written(told.select("scene_id", "start", "end", F.transform("instructions", lambda i: F.to_json(i)).alias("instructions")), "told")
    made = walks.join(told, ["scene_id", "start", "end"])
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy("start", "end")) - 1
    count = part = None
    if old is not None:
        count, part = old.groupBy("scene_id").agg(F.count("*").alias("n")), readers.free_part(old)
        made = made.join(count, "scene_id", "left").join(part, "scene_id", "left")
    made = made.withColumns({"pos": place, "part": F.coalesce("next_part", F.lit(1)) if old is not None else F.lit(1), "before": F.coalesce("n", F.lit(0)) if old is not None else F.lit(0)})
    samples = made.withColumn("trajectory_id", (F.col("before") + F.col("pos")).cast("string"))
    documents = writers.trajectory_documents(samples.select("scene_id", "pos", "trajectory_id", "instructions", "points"))
    writers.texts_by_scene(documents.join(samples.select("scene_id", "part").distinct(), "scene_id"), out, ("scene_id", "part"))


def to_scene(spark: SparkSession, trajectories: str, maps: str, out: str, only: list[str] | None = None, force: bool = False, no_flip_x: bool = False, no_flip_y: bool = False, no_negate: bool = False) -> None:
    """Trajectories in the scene's coordinates, mirrored within the bounds of its map and negated; scenes that are done are left out."""
    bounds = stats.map_bounds(instances(spark, maps), ["scene_id"])
    s = _todo(readers.trajectories(spark, trajectories, all_scenes=True), out, only, force, None).join(bounds, "scene_id")
    flat = F.transform("points", lambda p: F.struct(*(p["position"][k].alias(a) for k, a in enumerate("xyz")), *(p["rotation"][k].alias(f"q{a}") for k, a in enumerate("xyzw"))))
    poses = scene_poses(flat, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), not no_flip_x, not no_flip_y, not no_negate)
    points = F.transform(poses, lambda p, i: F.struct(i.cast("string").alias("point"), F.array(p["x"], p["y"], p["z"]).alias("position"), F.array(p["qx"], p["qy"], p["qz"], p["qw"]).alias("rotation")))
    writers.texts_by_scene(writers.trajectory_documents(s.select("scene_id", "pos", "trajectory_id", "instructions", points.alias("points"))), out)


def merge(spark: SparkSession, trajectories: str, out: str, only: list[str] | None = None, force: bool = False) -> None:
    """All parts of each scene in one document, renumbered; scenes that are done are left out."""
    s = _todo(readers.trajectories(spark, trajectories), out, only, force, None).withColumn("part", part_number(F.col("path")))
    merged = selection.merged_parts(s)
    writers.texts_by_scene(writers.trajectory_documents(merged.select("scene_id", F.col("trajectory_id").cast("long").alias("pos"), "trajectory_id", "instructions", "points")), out)


def statistics(spark: SparkSession, trajectories: str, out: str, only: list[str] | None = None, force: bool = False) -> None:
    """Per trajectory, per scene and over all scenes; nothing is done if the last of them is there, unless by force."""
    if not force and _there(spark, f"{out}/pairs/_SUCCESS"):
        return
    s = _some(readers.trajectories(spark, trajectories), only)
    t = s.select("scene_id", "trajectory_id", "pos", F.size("points").alias("n_points"))
    i = readers.instructions(s)
    info = stats.trajectory_info(t, i)
    cut = info.join(stats.tercile_thresholds(t, "n_points", ["scene_id"]), "scene_id")
    info = cut.withColumn("length_category", stats.length_category(F.col("n_points"), F.col("short"), F.col("long"))).drop("short", "long")
    info.write.mode("overwrite").partitionBy("scene_id").json(f"{out}/trajectories")
    scenes = stats.length_stats(t, "n_points", ["scene_id"]).join(stats.instruction_stats(info, ["scene_id"]), "scene_id").join(stats.location_stats(i, ["scene_id"]), "scene_id", "left").join(stats.histogram(info, "length_category", ["scene_id"]), "scene_id")
    scenes.write.mode("overwrite").json(f"{out}/scenes")
    whole = stats.length_stats(t, "n_points", []).join(F.broadcast(stats.global_terciles(t, "n_points")))  # one row
    whole.write.mode("overwrite").json(f"{out}/overall")
    pairs = i.where((stats.given("start").isNotNull()) & (stats.given("end").isNotNull()))
    stats.top_counts(pairs, ["start", "end"], [], 20, "trajectory_id").write.mode("overwrite").json(f"{out}/pairs")


def _there(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def split(spark: SparkSession, trajectories: str, types: str, out: str, val: int = 20, unseen: int = 15, target: int = 1000, scenes: int = 15, seed: int = 42) -> None:
    """Mappings of the five splits with the instructions that each has of a trajectory, and how they are distributed."""
    s = readers.trajectories(spark, trajectories)
    t = s.select("scene_id", "trajectory_id", F.size("instructions").cast("long").alias("instruction_count"), F.size("points").alias("n_points"))
    per = joins.scene_types(t.groupBy("scene_id").agg(F.sum("instruction_count").alias("pairs")), readers.scene_types(spark, types))
    found = selection.splits(per, t.select("scene_id", "trajectory_id", "instruction_count"), val, unseen, target, scenes)
    out_rows = None
    own = t.select("scene_id", "trajectory_id", F.col("instruction_count").alias("all"))
    for name, rows in found.items():
        rows = rows if "trajectory_id" in rows.columns else t.select("scene_id", "trajectory_id", "instruction_count").join(rows, "scene_id")
        n = F.col("taken") if "taken" in rows.columns else F.col("instruction_count")
        one = rows.select(F.lit(name).alias("split"), "scene_id", "trajectory_id", n.alias("instruction_count")).where("instruction_count > 0")
        out_rows = one if out_rows is None else out_rows.unionByName(one)
    cuts = stats.global_terciles(t, "n_points")
    full = out_rows.join(t.select("scene_id", "trajectory_id", "n_points"), ["scene_id", "trajectory_id"]).join(per.select("scene_id", "scene_type", "design_type"), "scene_id").join(F.broadcast(cuts))
    full = full.withColumn("length_category", stats.length_category(F.col("n_points"), F.col("short"), F.col("long"))).drop("short", "long", "n_points")
    # a trajectory's instructions in a random order: the test set has the first ones, training the others
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(F.col("all").cast("int") - 1, F.lit(0))), lambda i: F.struct(F.xxhash64("scene_id", "trajectory_id", i, F.lit(seed)).alias("h"), i.alias("i"))))
    full = full.join(own, ["scene_id", "trajectory_id"]).withColumn("order", F.transform(order, lambda x: x["i"]))
    n = F.col("instruction_count").cast("int")
    first, rest = F.slice("order", 1, n), F.slice("order", F.col("all").cast("int") - n + 1, n)
    full = full.withColumn("instructions", F.array_sort(F.when(F.col("split") == "instruction_unseen", first).otherwise(rest))).drop("order", "all")
    writers.split_files(full, stats.split_statistics(full.drop("instructions")), out)


def extract(spark: SparkSession, trajectories: str, splits: str, out: str, no_rename: bool = False) -> None:
    """The documents of each split, in folders of splits and scenes: of each trajectory that split() gives it, the instructions that it gives.

    Samples left without an instruction go, and scenes without a sample.  The
    folder has the name of the file that the scene's document is to have, under
    the split's prefix unless it is not to be renamed.
    """
    s = readers.trajectories(spark, trajectories)
    mapping = spark.read.json(f"{splits}/mappings").select("split", F.col("scene_id").cast("string").alias("scene_id"), F.col("trajectory_id").cast("string").alias("trajectory_id"), F.col("instructions").cast("array<int>").alias("picked"))
    last = s.groupBy("scene_id", "trajectory_id").agg(F.max("pos").alias("pos"))  # of a repeated id the last one
    rows = s.join(last, ["scene_id", "trajectory_id", "pos"], "left_semi").join(mapping, ["scene_id", "trajectory_id"])
    valid = F.filter("picked", lambda i: (i >= 0) & (i < F.size("instructions")))
    rows = rows.withColumn("instructions", F.transform(valid, lambda i: F.get("instructions", i))).where(F.size("instructions") > 0)
    prefix = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    file = F.regexp_replace(readers.name(F.col("path")), r"\.json$", "")
    bare = F.regexp_replace(file, r"^part-.*$", "trajectories")
    own = F.concat(prefix[F.col("split")], F.lit("_"), F.regexp_replace(bare, "^(train|val|test|trajectories_overall)_", ""))
    rows = rows.withColumn("file", bare if no_rename else own)
    key = ["split", "scene_id"]
    named = rows.groupBy(*key).agg(F.min("file").alias("file"))
    body = F.sort_array(F.collect_list(F.struct("pos", "trajectory_id", "instructions", "points")))
    samples = F.transform(body, lambda x: F.struct(x["trajectory_id"].alias("trajectory_id"), x["instructions"].alias("instructions"), x["points"].alias("points")))
    documents = rows.groupBy(*key).agg(samples.alias("samples")).join(named, key)
    value = F.to_json(F.struct(F.array(F.struct("scene_id", F.col("scene_id").alias("scene_name"), "samples")).alias("scenes")))
    writers.texts_by_scene(documents.select(*key, "file", value.alias("value")), out, ("split", "scene_id", "file"))


def actions(spark: SparkSession, trajectories: str, out: str, preset: str = "navila_small", config: str | None = None, limit: int | None = None) -> None:
    """The action sequence and one pose for each action of every trajectory, for each of its instructions.

    config: a JSON file with the name of a preset and values that replace its
    own; limit: trajectories of each scene.
    """
    how = act.preset(preset)
    if config:
        how = act.preset_from(spark.read.option("wholetext", "true").text(config).first().value, preset)
    s = readers.trajectories(spark, trajectories)
    if limit is not None:
        s = s.withColumn("place", F.row_number().over(Window.partitionBy("scene_id").orderBy("path", "pos"))).where(F.col("place") <= limit).drop("place")
    p = readers.points(s)
    p = p.select(F.concat_ws("|", "scene_id", "trajectory_id").alias("path_id"), "seq", "x", "y", "z", (2 * F.atan2(-F.col("qx"), F.col("qw"))).alias("yaw"))
    paths = act.as_arrays(act.smart_sample(p, how)).withColumn("actions", act.discretised(F.col("points"), how))
    poses = act.interpolated(paths, how)
    i = readers.instructions(s).withColumn("path_id", F.concat_ws("|", "scene_id", "trajectory_id"))
    i.join(poses, "path_id").drop("path_id").write.mode("overwrite").partitionBy("scene_id").json(out)


def pictures_of(spark: SparkSession, pictures: str) -> DataFrame:
    """(scene_id, trajectory_id, instruction_index, pos, frame) of pictures scene/trajectory_index/frame_pos.*, a scene's folder above that of its trajectories."""
    f = readers.files(spark, pictures, recursive=True)
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    split = lambda g: F.regexp_extract(part(2), r"^(.*)_(\d+)$", g)
    rows = f.select(F.url_decode(part(3)).alias("scene_id"), split(1).alias("trajectory_id"), split(2).try_cast("int").alias("instruction_index"), F.regexp_extract("file", r"(\d+)\.[^.]*$", 1).try_cast("int").alias("pos"), F.concat_ws("/", part(3), part(2), "file").alias("frame"))
    return rows.where("instruction_index is not null and pos is not null")


def images(spark: SparkSession, actions_path: str, pictures: str, out: str, shard: int = 0, shards: int = 1, limit: int | None = None, force: bool = False) -> DataFrame:
    """Metadata of the pictures that a renderer has made of each scene's actions; returns (scene_id, trajectory_id, expected, images) of what it still has to make.

    shard of shards: the renderer's part of the scenes; limit: trajectories of a
    scene; by force all that is expected is to be made again.
    """
    a = spark.read.json(actions_path).select(F.col("scene_id").cast("string").alias("scene_id"), F.col("trajectory_id").cast("string").alias("trajectory_id"), F.size("actions").alias("expected"))
    expected = a.groupBy("scene_id", "trajectory_id").agg(F.sum("expected").alias("expected"))
    expected = selection.sharded(expected, "scene_id", shards, shard)
    if limit is not None:
        expected = expected.withColumn("place", F.row_number().over(Window.partitionBy("scene_id").orderBy("trajectory_id"))).where(F.col("place") <= limit).drop("place")
    made = pictures_of(spark, pictures)
    writers.texts_by_scene(writers.image_metadata(made.join(expected.select("scene_id", "trajectory_id"), ["scene_id", "trajectory_id"], "left_semi")), out)
    return expected.withColumn("images", F.lit(0).cast("long")) if force else episodes.unfinished_images(expected, made)


def training(spark: SparkSession, actions_path: str, pictures: str, out: str, samples_per_part: int = 10_000, max_scenes: int | None = None) -> DataFrame:
    """Growing windows over the pictures of each sequence of actions, in parts; returns the manifest."""
    a = spark.read.json(actions_path)
    frames = pictures_of(spark, pictures).withColumn("there", F.lit(True))
    if max_scenes is not None:
        a = a.join(a.select("scene_id").distinct().orderBy("scene_id").limit(max_scenes), "scene_id", "left_semi")
    # a picture that is missing ends a sequence
    asked = a.select(F.col("scene_id").cast("string").alias("scene_id"), F.col("trajectory_id").cast("string").alias("trajectory_id"), F.col("instruction_index").cast("int").alias("instruction_index"), F.posexplode("actions").alias("pos", "action"))
    rows = asked.drop("action").join(frames, ["scene_id", "trajectory_id", "instruction_index", "pos"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return training_parts(a, rows, out, samples_per_part)


def training_parts(a: DataFrame, frames: DataFrame, out: str, size: int = 10_000) -> DataFrame:
    """training() of actions a and of frames(scene_id, trajectory_id, instruction_index, pos, frame, there)."""
    from .functions.text import next_action_text

    key = F.concat_ws("_", "scene_id", "trajectory_id", F.col("instruction_index").cast("string"))
    a = a.select(key.alias("video_id"), F.col("text").alias("q"), "actions")
    f = act.contiguous_frames(frames.withColumn("video_id", key))
    windows = act.training_windows(a.join(f, "video_id")).join(a.select("video_id", "q"), "video_id")
    samples = windows.select("video_id", "q", next_action_text(F.col("action")).alias("a"), "frames", "step")
    parts = writers.annotation_parts(samples, out, size, [F.xxhash64("video_id", "step", F.lit(42)), F.col("video_id"), F.col("step")])
    return writers.manifest(parts, samples)


def episode_files(spark: SparkSession, trajectories: str, out: str, radius: float = 0.5, pattern: str | None = None) -> None:
    """One episode for each trajectory and instruction."""
    s = readers.trajectories(spark, trajectories, pattern)
    writers.by_scene(episodes.adapted(s, radius), out, overwrite=True, fmt="json")


def evaluate(spark: SparkSession, steps: str, episodes_path: str, out: str, task: str = "vln", slice_start: int = 0, slice_size: int | None = None, no_resume: bool = False) -> None:
    """Measures of recorded steps(episode_id, seq, t, x, y, z, collided) of episodes that have none yet, one folder a scene.

    task: the measures are those of episodes with a goal, or without one for
    nogoalnav; slice: episodes by id, from a place on, so many of them.
    """
    e = episodes.for_task(spark.read.json(episodes_path), task)
    if slice_start or slice_size is not None:
        e = e.join(selection.sliced(e.select("episode_id"), ["episode_id"], None, slice_start, slice_size), "episode_id", "left_semi")
    goal = F.col("goals")[0]
    g = e.select("episode_id", *(goal["position"][k].alias(f"g{a}") for k, a in enumerate("xyz")), goal["radius"].alias("radius"))
    needed = ["path_length"] if task == "nogoalnav" else ["success", "spl", "path_length"]
    if not no_resume and _there(spark, out):
        done = spark.read.schema(", ".join(["episode_id string", *(f"{c} double" for c in needed)])).json(out)
        g = episodes.unfinished(g, done, needed)
    own = spark.read.parquet(steps).join(g.select("episode_id"), "episode_id", "left_semi")
    found = measures.evaluated(own) if task == "nogoalnav" else measures.evaluated(own, g)
    writers.append(found.join(e.select("episode_id", "scene_id"), "episode_id"), out, "json")


def scene_files(spark: SparkSession, template: str, scenes: str, out: str, placeholder: str = "{scene}", times: int = 1, limit: int | None = None) -> None:
    """A template filled with the name of each of the files whose stem is all digits, one text a scene; fails unless it holds the placeholder so many times."""
    text = readers.documents(spark, template).select(checked_template(F.col("value"), placeholder, times).alias("template"))
    names = readers.numbered_files(readers.files(spark, scenes)).select(F.col("stem").alias("scene_id")).distinct().orderBy("scene_id")
    names = names if limit is None else names.limit(limit)
    rows = names.join(F.broadcast(text))  # one row
    writers.texts_by_scene(episodes.scene_files(rows, F.col("template"), {placeholder: F.col("scene_id")}), out)
