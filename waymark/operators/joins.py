"""Joins: dimensions, mappings, exclusions, pairs, ranges and near positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_centre, in_box
from ..functions.text import any_of, tail_id
from ..scratch import written

#: Groups of labels that mean much the same.
SIMILAR = [
    ["chair", "stool", "armchair"],
    ["table", "desk", "dining_table"],
    ["bed", "sofa", "couch"],
    ["cabinet", "shelf", "bookshelf", "wardrobe"],
    ["lamp", "light", "ceiling_light"],
]
MIN_DISTANCE, MAX_DISTANCE, SEARCH = 2.0, 20.0, 2.0


def scene_types(scenes: DataFrame, types: DataFrame) -> DataFrame:
    """scenes(scene_id, ...) with scene_type and design_type of types(world_id, design_type); home without an entry."""
    dim = types.select(F.col("world_id").cast("string").alias("scene_id"), "design_type").dropDuplicates(["scene_id"])
    out = scenes.withColumn("scene_id", F.col("scene_id").cast("string")).join(dim, "scene_id", "left")
    return out.withColumns({"scene_type": F.when(F.col("design_type").isNull(), "home").otherwise("non_home"), "design_type": F.coalesce("design_type", F.lit("Home"))})


def selected_samples(mapping: DataFrame, samples: DataFrame) -> DataFrame:
    """samples(scene_id, trajectory_id, pos, ...) that the mapping names; of a repeated id the last one."""
    last = samples.groupBy("scene_id", "trajectory_id").agg(F.max("pos").alias("pos"))
    kept = samples.join(last, ["scene_id", "trajectory_id", "pos"], "left_semi")
    return mapping.join(kept, ["scene_id", "trajectory_id"])


def selected_instructions(mapping: DataFrame, instructions: DataFrame) -> DataFrame:
    """instructions(scene_id, trajectory_id, instruction_index, ...) at the indices of mapping(..., indices array<int>); indices without one are skipped."""
    wanted = mapping.select("scene_id", "trajectory_id", F.explode("indices").alias("instruction_index"))
    return instructions.join(wanted, ["scene_id", "trajectory_id", "instruction_index"])


def actions_with_images(actions: DataFrame, images: DataFrame) -> DataFrame:
    """Inner join by trajectory and instruction; of repeated images(pos) the last one."""
    keys = ["trajectory_id", "instruction_index"]
    last = images.groupBy(*keys).agg(F.max_by("frames", "pos").alias("frames"))
    return actions.join(last, keys)


def new_pairs(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    return pairs.join(existing, ["start", "end"], "left_anti")


def train_remainder(instructions: DataFrame, unseen_trajectories: DataFrame, unseen_instructions: DataFrame) -> DataFrame:
    """instructions(scene_id, trajectory_id, instruction_index, ...) that neither test set holds."""
    rest = instructions.join(unseen_trajectories, ["scene_id", "trajectory_id"], "left_anti")
    return rest.join(unseen_instructions, ["scene_id", "trajectory_id", "instruction_index"], "left_anti")


def without_bad_scenes(scenes: DataFrame, bad: DataFrame) -> DataFrame:
    """scenes(scene_key, ...) whose tail id is not in bad(scene_id)."""
    return scenes.join(bad.select(F.col("scene_id").alias("__bad")), tail_id(F.col("scene_key")) == F.col("__bad"), "left_anti")


def on_the_map(items: DataFrame, instances: DataFrame) -> DataFrame:
    """items(scene_id, item_id, ...) that instances(scene_id, item_id) have too, in order."""
    return items.join(instances.select("scene_id", "item_id").distinct(), ["scene_id", "item_id"], "left_semi").orderBy("scene_id", "item_id")


def similar_group(label: Column) -> Column:
    found = F.lit(None).cast("int")
    for k, names in enumerate(SIMILAR):
        found = F.coalesce(F.when(F.lower(label).isin(names), F.lit(k)), found)
    return found


def candidate_pairs(items: DataFrame, by: str = "scene_id", least: float = MIN_DISTANCE, most: float = MAX_DISTANCE) -> DataFrame:
    """Ordered pairs (by, start, end, distance) of a scene's items(by, item_id, label, x, y) that differ in
    label and in its group and lie between the two distances, bounds included.

    Items are dealt to square cells as wide as the greatest distance, so only
    items of neighbouring cells are paired.
    """
    at = lambda c: F.floor(F.col(c) / most)
    cells = items.select(by, "item_id", F.lower("label").alias("label"), similar_group(F.col("label")).alias("grp"), "x", "y", at("x").alias("cx"), at("y").alias("cy"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = cells.withColumn("o", F.explode(around))
    one = spread.select(by, (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.col("item_id").alias("start"), F.col("label").alias("l1"), F.col("grp").alias("g1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    two = cells.select(by, "cx", "cy", F.col("item_id").alias("end"), F.col("label").alias("l2"), F.col("grp").alias("g2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    pairs = one.join(two, [by, "cx", "cy"]).where("start <> end and l1 <> l2 and not coalesce(g1 = g2, false)")
    return pairs.withColumn("distance", d).where(F.col("distance").between(least, most)).select(by, "start", "end", "distance")


def priority(item_id: Column, category: Column) -> Column:
    """How likely an object is meant as a target; lower first.  Fixed values: the words and their ranks."""
    i, c = F.lower(item_id), F.lower(category)
    either = lambda words: any_of(i, words) | any_of(c, words)
    return (
        F.when(either(["screen", "projector"]), 1).when(either(["table", "desk"]), 2).when(either(["chair"]), 3)
        .when(any_of(c, ["furniture", "cabinet", "shelf", "bookcase"]), 4).when(either(["unable"]), 10).otherwise(5)
    )


def near_objects(targets: DataFrame, objects: DataFrame, by: str = "scene_id", radius: float = SEARCH) -> DataFrame:
    """targets(by, target_id, x, y) with each of objects(by, item_id, category, box, pos) whose box centre is within the radius.

    An equi-join on cells as wide as the radius.
    """
    centre = box_centre(F.col("box"))
    o = objects.withColumn("c", centre).where("c is not null").select(by, "item_id", "category", "box", "pos", F.col("c")[0].alias("ox"), F.col("c")[1].alias("oy"))
    o = o.withColumns({"gx": F.floor(F.col("ox") / radius), "gy": F.floor(F.col("oy") / radius)})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    t = targets.withColumn("o", F.explode(around)).withColumns({"gx": F.floor(F.col("x") / radius) + F.col("o.i"), "gy": F.floor(F.col("y") / radius) + F.col("o.j")}).drop("o")
    found = t.join(o, [by, "gx", "gy"]).withColumn("distance", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))
    return found.where(F.col("distance") <= radius).drop("gx", "gy", "ox", "oy")


def best_targets(near: DataFrame, keys: list[str]) -> DataFrame:
    """Of each target's near_objects() the one with the least priority, then distance, then place."""
    p = near.withColumn("priority", priority(F.col("item_id"), F.col("category")))
    best = F.min_by(F.struct("item_id", "category", "box", "distance", "priority"), F.struct("priority", "distance", "pos"))
    return p.groupBy(*keys).agg(F.count("*").alias("candidates"), best.alias("b")).select(*keys, "candidates", "b.*")


def object_success(agents: DataFrame, objects: DataFrame, radius: float = 1.0, too_far: float = 5.0) -> DataFrame:
    """(episode_id, method, success) for agents(episode_id, scene_id, x, y, end_item, tx, ty, d_goal, goal_radius, free).

    Positions are in map coordinates; (tx, ty) is the path's end, free tells
    that the place is free of obstacles (null: unknown, free).  The labelled
    object decides unless it is unknown, or farther than too_far although the
    agent is not at it; then the best object near the path's end does, then the
    distance to that end, and without an end the distance to the goal.
    """
    free = F.coalesce("free", F.lit(True))
    label = objects.groupBy("scene_id", F.col("item_id").alias("end_item")).agg(F.max_by("box", "pos").alias("label_box"))
    a = agents.join(label, ["scene_id", "end_item"], "left")
    targets = agents.where("tx is not null").select("scene_id", "episode_id", F.col("tx").alias("x"), F.col("ty").alias("y"))
    best = best_targets(near_objects(targets, objects), ["episode_id"]).select("episode_id", F.col("box").alias("best_box"))
    a = a.join(best, "episode_id", "left")
    at_label = F.coalesce(in_box(F.col("x"), F.col("y"), F.col("label_box"), radius), F.lit(False))
    centre = box_centre(F.col("label_box"))
    far = F.hypot(F.col("x") - centre[0], F.col("y") - centre[1]) > too_far
    smart = F.col("label_box").isNull() | (~at_label & F.coalesce(far, F.lit(False)))
    method = F.when(~smart, "object").when(F.col("tx").isNull(), "point").when(F.col("best_box").isNotNull(), "inferred").otherwise("distance")
    by = {
        "object": at_label & free,
        "inferred": in_box(F.col("x"), F.col("y"), F.col("best_box"), radius) & free,
        "distance": F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")) <= radius,
        "point": F.col("d_goal") < F.coalesce("goal_radius", F.lit(0.5)),
    }
    a = a.withColumn("method", method)
    success = F.lit(False)
    for k, v in by.items():
        success = F.when(F.col("method") == k, v).otherwise(success)
    return a.select("episode_id", "method", F.coalesce(success, F.lit(False)).alias("success"))


def nearest_waypoint(positions: DataFrame, waypoints: DataFrame, by: str) -> DataFrame:
    """positions(by, position_id, x, y) with the closest of waypoints(by, seq, x, y), the first of equals.

    Positions of a key without a waypoint give no row.  Square cells, of a width
    that gives each key about one waypoint a cell, meet their neighbours; a
    position whose closest one there is within a cell's width is settled, the
    others go on with cells four times as wide, until a cell is as wide as
    the key's extent.
    """
    w = waypoints.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(by, "seq", F.col("x").alias("wx"), F.col("y").alias("wy"))
    p = positions.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(by, "position_id", "x", "y")
    ends = lambda f, c, d: f(F.coalesce(c, d))
    both = p.select(by, "x", "y", F.lit(0).alias("n")).unionByName(w.select(by, F.col("wx").alias("x"), F.col("wy").alias("y"), F.lit(1).alias("n")))
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    cells = both.groupBy(by).agg(ends(F.sum, F.col("n"), F.lit(0)).alias("n"), extent.alias("extent")).where("n > 0")
    cells = written(cells.select(by, "extent", (F.col("extent") / F.sqrt("n") + 1e-9).alias("cell")), "extents", few=True)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    found, scale = None, 1
    while True:
        size = F.col("cell") * scale
        at = lambda c: F.floor(F.col(c) / size)  # noqa: E731, B023
        one = p.join(cells, by).withColumn("o", F.explode(around))
        one = one.select(by, "position_id", "x", "y", (at("x") + F.col("o.i")).alias("cx"), (at("y") + F.col("o.j")).alias("cy"), size.alias("size"), (size > F.col("extent")).alias("last"))
        two = w.join(cells, by).select(by, "seq", "wx", "wy", at("wx").alias("cx"), at("wy").alias("cy"))
        d = F.hypot(F.col("x") - F.col("wx"), F.col("y") - F.col("wy"))
        best = one.join(two, [by, "cx", "cy"]).groupBy(by, "position_id", "size", "last").agg(F.min_by("seq", F.struct(d, "seq")).alias("nearest"), F.min(d).alias("distance"))
        done = written(best.where("last or distance <= size").select(by, "position_id", "nearest", "distance"), "nearest", few=True)
        found = done if found is None else found.unionByName(done)
        p = written(p.join(cells.select(by), by, "left_semi").join(done, [by, "position_id"], "left_anti"), "far", few=True)
        if p.isEmpty():
            return found
        scale *= 4


def correspondence(endpoints: DataFrame, trajectories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., state): complete, or which of the two files is missing."""
    e, t = endpoints.select(*keys).distinct().withColumn("e", F.lit(True)), trajectories.select(*keys).distinct().withColumn("t", F.lit(True))
    state = F.when(F.col("e") & F.col("t"), "complete").when(F.col("e"), "no_trajectory").otherwise("no_endpoints")
    return e.join(t, keys, "full_outer").select(*keys, state.alias("state"))


def with_default(rows: DataFrame, found: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Left join; a row without a match gets the defaults."""
    hit = found.withColumn("__hit", F.lit(True))
    out = rows.join(hit, keys, "left")
    return out.withColumns({c: F.when(F.col("__hit").isNull(), v).otherwise(F.col(c)) for c, v in defaults.items()}).drop("__hit")


#: Names of a scene's file and of its map, the preferred first; {} is the scene, * any text.
SCENE_FILES = ["{}.usda", "{}.usd", "*{}*.usda", "*{}*.usd"]
MAP_FILES = ["2D_Semantic_Map_*_{}_Complete.json", "2D_Semantic_Map_{}_Complete.json", "*_{}_Complete.json", "*{}*.json"]


def ranked_match(wanted: DataFrame, files: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """wanted(name) with file, that of files(file) which the first fitting pattern finds, and rank, the pattern's place; of equals the first by name.

    In a pattern, {} stands for the name and * for any text.  A file gives a key
    for each text that a name could be: the one that a pattern without * leaves,
    the ends after each place where what a pattern has around {} may stand, or
    all parts between the lengths of the shortest and the longest name.  Names
    then meet files on equal keys.  A name without a file gives no row.
    """
    low, high = wanted.agg(F.coalesce(F.min(F.length(name)), F.lit(0)), F.coalesce(F.max(F.length(name)), F.lit(0))).first()
    found = None
    for rank, pattern in enumerate(patterns):
        before, after = pattern.split("{}")
        head, free = before.rstrip("*").split("*")[0], before.startswith("*") or "*" in before
        lead = before.rsplit("*", 1)[-1]  # what stands right before the name
        tail, loose = after.lstrip("*"), after.startswith("*")
        f = F.col("file")
        body = F.expr(f"substring(file, 1, length(file) - {len(tail)})")
        fits = f.startswith(head) & f.endswith(tail) & (F.length(f) >= len(head) + len(tail))
        starts = F.array(F.lit(len(head) + 1)) if not free else F.sequence(F.lit(len(head) + 1), F.greatest(F.lit(len(head) + 1), F.length(body) + 1))
        lengths = F.sequence(F.lit(low), F.lit(high))
        if loose:
            parts = F.flatten(F.transform(starts, lambda i: F.transform(lengths, lambda n: F.struct(i.alias("i"), n.alias("n")))))  # noqa: B023
        else:
            parts = F.transform(starts, lambda i: F.struct(i.alias("i"), (F.length(body) - i - len(lead) * int(free) + 1).alias("n")))  # noqa: B023
        skip = len(lead) if free else 0
        good = lambda x: (x["n"] >= low) & (x["n"] <= high) & (F.substring(body, x["i"], F.lit(skip)) == lead if skip else F.lit(True)) & (x["i"] + skip + x["n"] - 1 <= F.length(body))  # noqa: E731, B023
        keys = F.array_distinct(F.transform(F.filter(parts, good), lambda x: F.substring(body, x["i"] + skip, x["n"])))  # noqa: B023
        one = files.where(fits).select("file", F.explode(keys).alias(name), F.lit(rank).alias("rank"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(name).agg(F.min(F.struct("rank", "file")).alias("m"))
    return wanted.join(best, name).select(*wanted.columns, "m.file", "m.rank")


def first_by_pattern(files: DataFrame, patterns: list[str]) -> DataFrame:
    """files(scene_id, file) that match the earliest of the patterns that any file of the scene matches."""
    rank = F.lit(len(patterns))
    for k, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col("file").rlike(p), k).otherwise(rank)
    least = F.min("rank").over(Window.partitionBy("scene_id"))
    return files.withColumn("rank", rank).withColumn("least", least).where("rank = least").drop("least")


def contiguous_parts(parts: DataFrame) -> DataFrame:
    """parts(scene_id, part, ...) from 1 on up to the first gap."""
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy("part"))
    return parts.withColumn("__p", place).where(F.col("part") == F.col("__p")).drop("__p")


def next_part(parts: DataFrame) -> DataFrame:
    """(scene_id, next_part): the least free part from 2 on."""
    w = Window.partitionBy("scene_id").orderBy("part")
    own = parts.where("part >= 2").select("scene_id", "part").distinct().withColumn("__p", F.row_number().over(w) + 1)
    filled = own.where("part = __p").groupBy("scene_id").agg((F.max("part") + 1).alias("next_part"))
    return parts.select("scene_id").distinct().join(filled, "scene_id", "left").fillna(2, ["next_part"])
