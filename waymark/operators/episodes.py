"""Episodes of trajectories and the tasks that they may set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised_instruction

#: Radii and limits of the tasks, words that name objects, default sentences.
TASK_RADIUS = {"vln": 0.5, "objectnav": 1.0, "pointnav": 0.2, "imgnav": 1.0}
IMAGE_LIKENESS, TIME_LIMIT, COVERAGE = 0.8, 80.0, 0.25
OBJECT_WORDS = [("folder", "folder"), ("window", "window"), ("chair", "chair"), ("screen", "projection_screen"), ("projection", "projection_screen"), ("notebook", "notebook"), ("cup", "cup")]
DEFAULT_INSTRUCTION = "Navigate to the destination"
EXPLORE = "Explore this environment as much as possible, but avoid colliding with objects, walls, etc., and maintain safe navigation."


def adapted(samples: DataFrame, radius: float = 0.5) -> DataFrame:
    """One episode for each instruction of samples(scene_id, scene_name, trajectory_id, instructions array<string>, points).

    The goal is the last point; a sample without points gives none.
    """
    last = F.element_at("points", -1)
    first = F.element_at("points", 1)
    rows = samples.where(F.size("points") > 0).select("*", F.posexplode("instructions").alias("instruction_index", "raw"))
    i = normalised_instruction(F.col("raw"))
    return rows.select(
        "scene_id", "scene_name", F.concat_ws("-", "trajectory_id", F.col("instruction_index").cast("string")).alias("episode_id"), "trajectory_id", "instruction_index",
        F.struct(i["generated_instruction"].alias("instruction_text")).alias("instruction"), i["instruction_type"].alias("instruction_type"), i["start"].alias("start_item"), i["end"].alias("end_item"),
        first["position"].alias("start_position"), first["rotation"].alias("start_rotation"),
        F.array(F.struct(F.lit(radius).alias("radius"), last["position"].alias("position"))).alias("goals"),
        F.transform("points", lambda p: p["position"]).alias("gt_locations"), F.transform("points", lambda p: p["position"]).alias("reference_path"),
    )


@dataclass(frozen=True)
class Task:
    """What a task adds to an episode, and when it is reached, from columns by name (distance, likeness, collided, seconds, coverage)."""

    columns: Callable[[], dict[str, Column]]
    reached: Callable[[dict[str, Column]], Column]


def _last() -> Column:
    return F.element_at("gt_locations", -1)


def _origin() -> Column:
    return F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))


#: The tasks by name; register() adds more.
TASKS: dict[str, Task] = {
    "vln": Task(lambda: {}, lambda c: c["distance"] < TASK_RADIUS["vln"]),
    "objectnav": Task(lambda: {"target_object": target_object(F.col("instruction.instruction_text")), "target_object_position": _last()}, lambda c: c["distance"] <= TASK_RADIUS["objectnav"]),
    "pointnav": Task(lambda: {"goal_position": F.coalesce(_last(), _origin())}, lambda c: c["distance"] < TASK_RADIUS["pointnav"]),
    "imgnav": Task(lambda: {"target_image_position": _last()}, lambda c: (c["distance"] <= TASK_RADIUS["imgnav"]) & F.coalesce(c["likeness"] > IMAGE_LIKENESS, F.lit(True))),
    "nogoalnav": Task(lambda: {"start_position": F.coalesce(F.element_at("gt_locations", 1), _origin())}, lambda c: ~c["collided"] & ((c["seconds"] >= TIME_LIMIT) | (c["coverage"] >= COVERAGE))),
}


def register(name: str, task: Task) -> None:
    if name in TASKS:
        raise ValueError(f"there is a task {name}")
    TASKS[name] = task


def task_type(has: dict[str, Column]) -> Column:
    """The task of an episode.  has: columns task_type, instruction_type, instructions, target_object, target_image and goal_position; those it lacks are null."""
    get = lambda k: has.get(k, F.lit(None))
    no_goal = (get("task_type") == "no_goal_exploration") | (get("instruction_type") == "Goal-less")
    return (
        F.when(F.coalesce(no_goal, F.lit(False)), "nogoalnav").when(get("instructions").isNotNull(), "vln").when(get("target_object").isNotNull(), "objectnav")
        .when(get("target_image").isNotNull(), "imgnav").when(get("goal_position").isNotNull(), "pointnav").otherwise("vln")
    )


def target_object(text: Column) -> Column:
    """The object that an instruction names, by the first word found; else unknown."""
    t = F.lower(text)
    found = F.when(t.contains(OBJECT_WORDS[0][0]), OBJECT_WORDS[0][1])
    for w, n in OBJECT_WORDS[1:]:
        found = found.when(t.contains(w), n)
    return found.otherwise("unknown")


def for_task(episodes: DataFrame, task: str) -> DataFrame:
    """Episodes with the columns of a task: its target or start."""
    if task.lower() not in TASKS:
        raise ValueError(f"no task {task}; there are {', '.join(TASKS)}")
    new = TASKS[task.lower()].columns()
    return episodes.withColumns(new) if new else episodes


def instruction_for(task: Column, texts: Column, step: Column, target: Column, goal: Column) -> Column:
    """The sentence that an agent is told at a step."""
    own = F.when(F.size(texts) > 0, F.get(texts, F.pmod(step, F.size(texts))))
    at = F.concat_ws(", ", *(F.format_string("%.2f", F.get(goal, F.lit(k))) for k in range(3)))
    return (
        F.when(task == "objectnav", F.concat(F.lit("Find the "), target)).when(task == "pointnav", F.concat(F.lit("Navigate to coordinates ("), at, F.lit(")")))
        .when(task == "imgnav", "Navigate to the location that matches the target image").when(task == "nogoalnav", F.coalesce(own, F.lit(EXPLORE))).otherwise(F.coalesce(own, F.lit(DEFAULT_INSTRUCTION)))
    )


def reached(task: Column, distance: Column, likeness: Column, collided: Column, seconds: Column, coverage: Column) -> Column:
    """Success of a task (image tasks without a likeness go by the position); without a goal it is to explore long or far enough and not to collide.  Unknown tasks are as vln."""
    has = {"distance": distance, "likeness": likeness, "collided": collided, "seconds": seconds, "coverage": coverage}
    out = F.when(task == "vln", TASKS["vln"].reached(has))
    for name, own in TASKS.items():
        out = out if name == "vln" else out.when(task == name, own.reached(has))
    return out.otherwise(TASKS["vln"].reached(has))


def exploration_over(collided: Column, seconds: Column) -> Column:
    return collided | (seconds >= TIME_LIMIT)


def unfinished(episodes: DataFrame, measured: DataFrame, needed: list[str]) -> DataFrame:
    """Episodes without a record that has all needed measures."""
    whole = measured
    for c in needed:
        whole = whole.where(F.col(c).isNotNull())
    return episodes.join(whole.select("episode_id").distinct(), "episode_id", "left_anti")


def unfinished_images(expected: DataFrame, made: DataFrame) -> DataFrame:
    """Rows of expected(scene_id, trajectory_id, expected) with fewer images in made(scene_id, trajectory_id)."""
    n = made.groupBy("scene_id", "trajectory_id").agg(F.count("*").alias("images"))
    return expected.join(n, ["scene_id", "trajectory_id"], "left").fillna(0, ["images"]).where("images < expected")


def scene_files(scenes: DataFrame, template: Column, values: dict[str, Column]) -> DataFrame:
    """scenes with value: the template with its placeholders replaced."""
    from ..functions.text import filled

    return scenes.withColumn("value", filled(template, values))
