"""Measures of episodes from tables of recorded steps.

steps(episode_id, seq, t, x, y, z, collided); goals(episode_id, gx, gy, gz[,
radius]).  All measures of an episode come from one window order and one
aggregation by episode_id, so the steps are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import coarse_cell, distance

#: Radii and thresholds of the measures.
RADIUS, CELL, CELLS, RECOVERY = 0.5, 0.5, 400, 2


def _order() -> WindowSpec:
    return Window.partitionBy("episode_id").orderBy("seq")


def expand_cadence(steps: DataFrame) -> DataFrame:
    """Samples as a loop takes them that looks before and after each move: p0, p0, p1, p1, p2, ..."""
    twice = steps.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    last = F.max("seq").over(Window.partitionBy("episode_id"))
    kept = twice.withColumn("last", last).where((F.col("copy") == 0) | (F.col("seq") < F.col("last")))
    return kept.withColumn("seq", F.col("seq") * 2 + F.col("copy")).drop("copy", "last")


def with_moves(steps: DataFrame) -> DataFrame:
    """steps with the distance from the step before (moved, 0 at first)."""
    lag = lambda c: F.lag(c).over(_order())
    return steps.withColumn("moved", F.coalesce(distance(*((F.col(a), lag(a)) for a in "xyz")), F.lit(0.0)))


def with_goals(steps: DataFrame, goals: DataFrame) -> DataFrame:
    """steps with the distance to their episode's goal (to_goal) and its radius; the origin without a goal."""
    joined = steps.join(goals, "episode_id", "left")
    radius = F.col("radius") if "radius" in goals.columns else F.lit(None).cast("double")
    to = distance(*((F.col(a), F.coalesce(F.col(f"g{a}"), F.lit(0.0))) for a in "xyz"))
    return joined.withColumn("to_goal", to).withColumn("radius", F.coalesce(radius, F.lit(RADIUS)))


def recovering(collided: Column) -> Column:
    """A collision in this sample or the two before."""
    return F.max(collided.cast("int")).over(_order().rowsBetween(-RECOVERY, 0))


def with_turns(steps: DataFrame) -> DataFrame:
    """steps with turned, the change of velocity since the last step that moved, of those that move."""
    lag = lambda c: F.lag(c).over(_order())
    v = steps.withColumns({"vx": F.col("x") - lag("x"), "vy": F.col("y") - lag("y")})
    moves = F.hypot("vx", "vy") > 1e-6
    before = F.last(F.when(moves, F.struct("vx", "vy")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    v = v.withColumn("before", before)
    return v.withColumn("turned", F.when(moves, F.hypot(F.col("vx") - F.col("before.vx"), F.col("vy") - F.col("before.vy")))).drop("vx", "vy", "before")


# name: expression over the prepared samples of an episode
MEASURES: dict[str, Callable[[], Column]] = {}


def measure(name: str) -> Callable:
    """Registers a measure: a function without arguments that returns an aggregate of prepared samples."""

    def register(f: Callable[[], Column]) -> Callable[[], Column]:
        MEASURES[name] = f
        return f

    return register


last_of = lambda c: F.max_by(c, F.col("seq"))


@measure("path_length")
def _path_length() -> Column:
    return F.sum("moved")


@measure("distance_to_goal")
def _distance_to_goal() -> Column:
    return last_of(F.col("to_goal"))


@measure("navigation_error")
def _navigation_error() -> Column:
    return last_of(F.col("to_goal"))


@measure("success")
def _success() -> Column:
    return last_of(F.col("reached").cast("double"))


@measure("spl")
def _spl() -> Column:
    """Success times the ratio of the straight line from the start to the path."""
    straight = F.min_by("to_goal", "seq")
    ratio = F.when(straight == 0, 1.0).otherwise(F.try_divide(straight, F.greatest(straight, F.sum("moved"))))
    return last_of(F.col("reached").cast("double")) * ratio


@measure("oracle_success")
def _oracle_success() -> Column:
    return F.max(F.col("oracle").cast("double"))


@measure("continuous_success_ratio")
def _continuous() -> Column:
    return F.avg(F.col("close").cast("double"))


@measure("integrated_collision_penalty")
def _icp() -> Column:
    return F.avg("recovering")


@measure("collision_count")
def _collisions() -> Column:
    return F.sum(F.col("collided").cast("long"))


@measure("episode_time")
def _time() -> Column:
    return F.max("t") - F.min("t")


@measure("explored_areas")
def _areas() -> Column:
    return F.count_distinct(coarse_cell(F.col("x"), CELL), coarse_cell(F.col("y"), CELL))


@measure("exploration_coverage")
def _coverage() -> Column:
    return F.least(F.count_distinct(coarse_cell(F.col("x"), CELL), coarse_cell(F.col("y"), CELL)) / CELLS, F.lit(1.0))


@measure("path_smoothness")
def _smoothness() -> Column:
    """1 / (1 + 10 * mean change of velocity) over the steps that move; 1 with fewer than two."""
    return F.coalesce(1 / (1 + 10 * F.avg("turned")), F.lit(1.0))


GOAL_MEASURES = ["distance_to_goal", "success", "oracle_success", "path_length", "spl", "navigation_error", "collision_count", "continuous_success_ratio", "integrated_collision_penalty", "path_smoothness"]
NO_GOAL_MEASURES = ["collision_count", "integrated_collision_penalty", "path_smoothness", "episode_time", "explored_areas", "exploration_coverage"]


def prepared(steps: DataFrame, goals: DataFrame | None = None, areas: dict[str, Column] | None = None) -> DataFrame:
    """Samples with moved, turned, recovering and, for goals, to_goal, radius, reached, oracle and close.

    areas: boolean columns of steps for reached, oracle and close where objects
    are known; null falls back to the distance.
    """
    rows = with_turns(with_moves(steps)).withColumn("recovering", recovering(F.col("collided")))
    if goals is None:
        return rows
    rows = with_goals(rows, goals)
    d, r = F.col("to_goal"), F.col("radius")
    near = {"reached": d < r, "oracle": d < F.greatest(3 * r, F.lit(1.5)), "close": d <= F.greatest(4 * r, F.lit(2.0))}
    areas = areas or {}
    return rows.withColumns({k: F.coalesce(areas[k], v) if k in areas else v for k, v in near.items()})


def evaluated(steps: DataFrame, goals: DataFrame | None = None, names: list[str] | None = None, areas: dict[str, Column] | None = None) -> DataFrame:
    """(episode_id, one column for each measure); registered ones by name, without goals those that need none."""
    names = names or (GOAL_MEASURES if goals is not None else NO_GOAL_MEASURES)
    rows = prepared(steps, goals, areas)
    return rows.groupBy("episode_id").agg(*(MEASURES[n]().alias(n) for n in names), F.count("*").alias("n_samples")).select("episode_id", *names, "n_samples")


def stuck(steps: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(episode_id, stuck): all steps lie within the tolerance of the first."""
    first = lambda c: F.first(c).over(_order())
    far = steps.withColumn("far", distance(*((F.col(a), first(a)) for a in "xyz")))
    return far.groupBy("episode_id").agg((F.max("far") <= tolerance).alias("stuck"))


def until_reached(steps: DataFrame, goals: DataFrame) -> DataFrame:
    """Steps up to and with the first one within the goal's radius; all if there is none."""
    rows = with_goals(steps, goals)
    stop = F.min(F.when(F.col("to_goal") < F.col("radius"), F.col("seq"))).over(Window.partitionBy("episode_id"))
    return rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("seq") <= F.col("stop"))).select(*steps.columns)


def consecutive_collisions(moves: DataFrame) -> DataFrame:
    """moves(episode_id, seq, intended, actual) with the running count of blocked moves.

    A move that covers under 30 % of an intended 5 cm or more adds one, one that
    covers over 60 % resets the count, others and turns leave it.
    """
    share = F.try_divide(F.col("actual"), F.col("intended"))
    moving = F.col("intended") > 0.001
    hit = moving & (share < 0.3) & (F.col("intended") > 0.05)
    reset = moving & ~hit & (share > 0.6)
    rows = moves.withColumns({"hit": F.coalesce(hit, F.lit(False)).cast("int"), "reset": F.coalesce(reset, F.lit(False)).cast("int")})
    rows = rows.withColumn("stretch", F.sum("reset").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("episode_id", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("blocked", F.sum("hit").over(run)).drop("hit", "reset", "stretch")


def blocked_moves(moves: DataFrame) -> DataFrame:
    """moves(intended, actual, ...) with the physics fallback: moved over 2 cm unasked, or under half of an intended 5 cm."""
    i, a = F.col("intended"), F.col("actual")
    return moves.withColumn("collided", (i.isNull() & (a > 0.02)) | ((i > 0.05) & (a < 0.5 * i)))


def recovered_commands(commands: DataFrame) -> DataFrame:
    """commands(episode_id, seq, vx, yaw_rate) with missing ones replaced: half of the last one, or else creeping."""
    last = lambda c: F.last(c, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    missing = F.col("vx").isNull()
    old = last("vx")
    return commands.withColumns({
        "new_vx": F.when(missing, F.coalesce(old * 0.5, F.lit(0.1))).otherwise(F.col("vx")),
        "new_yaw_rate": F.when(missing, F.coalesce(last("yaw_rate") * 0.5, F.lit(0.0))).otherwise(F.col("yaw_rate")),
    })


def overridden_stops(steps: DataFrame, seed: str = "0") -> DataFrame:
    """steps(episode_id, seq, action, ...) of episodes without a goal: STOP becomes a move or a turn drawn by the step."""
    pick = F.element_at(F.array(F.lit("MOVE_FORWARD"), F.lit("TURN_LEFT"), F.lit("TURN_RIGHT")), (F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(3)) + 1).cast("int"))
    stop = F.col("action") == "STOP"
    return steps.withColumns({"overridden": stop, "action": F.when(stop, pick).otherwise(F.col("action"))})


def last_mean(runs: DataFrame, n: int = 20) -> DataFrame:
    """runs(batch, seq, seconds) with the mean over the last n of them."""
    return runs.withColumn("mean_seconds", F.avg("seconds").over(Window.partitionBy("batch").orderBy("seq").rowsBetween(1 - n, 0)))


def progress(runs: DataFrame, total: int, n: int = 20) -> DataFrame:
    """runs(batch, seq, reached, seconds) with done, the share reached so far, the mean over the last n seconds and eta, the seconds that the rest of total will take at that."""
    so_far = Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = last_mean(runs, n).withColumns({"done": F.count("*").over(so_far), "reached_share": F.avg(F.col("reached").cast("double")).over(so_far)})
    return rows.withColumn("eta", F.greatest(F.lit(0), F.lit(total) - F.col("done")) * F.col("mean_seconds"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row for runs(file, ran, skipped, reached, seconds): counts, rates over what ran, true mean success, time used for tests."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ran, skipped = F.col("ran"), F.col("skipped")
    tested = ran & ~skipped
    return runs.agg(
        F.count_distinct("file").alias("files"), F.count("*").alias("episodes"), n(ran | skipped).alias("completed"), n(~ran & ~skipped).alias("failed"),
        F.coalesce(F.try_divide(n(ran | skipped), F.count("*")), F.lit(0.0)).alias("completion_rate"),
        F.coalesce(F.try_divide(n(tested), n(~skipped)), F.lit(0.0)).alias("tested_rate"),
        F.coalesce(F.avg(F.when(tested, F.col("reached").cast("double"))), F.lit(0.0)).alias("mean_success"),
        F.coalesce(F.try_divide(F.sum(F.when(tested, F.col("seconds"))), F.sum("seconds")), F.lit(0.0)).alias("efficiency"),
    )


def file_summary(files: DataFrame, runs: DataFrame) -> DataFrame:
    """files(file) with the number of runs and of completed ones; 0 for files without a run."""
    per = runs.groupBy("file").agg(F.count("*").alias("episodes"), F.sum((F.col("ran") | F.col("skipped")).cast("long")).alias("completed"))
    return files.join(per, "file", "left").fillna(0, ["episodes", "completed"])
