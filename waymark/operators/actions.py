"""Action sequences, sampled points and training windows of trajectories.

points: array of struct<x, y, z, yaw> in path order, or the long table
points(path_id, seq, x, y, z, yaw).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import normalised


@dataclass(frozen=True)
class Preset:
    """Step sizes of an action vocabulary; intervals of smart sampling."""

    move: float
    turn: float
    most: int
    straight_every: int = 5
    turn_every: int = 1
    turn_threshold: float = 0.1


#: Step lengths in metres, turns in degrees, most actions.
PRESETS = {
    "vlnce": Preset(0.25, 15, 50),
    "navila_small": Preset(0.35, 30, 50),
    "navila_large": Preset(0.75, 15, 30),
    "custom_small": Preset(0.50, 30, 60),
}

MIN_TURN = math.radians(15)

def _order() -> WindowSpec:
    return Window.partitionBy("path_id").orderBy("seq")


def preset(name: str, **changes) -> Preset:
    """A named preset, with some of its values changed."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {', '.join(PRESETS)}")
    return Preset(**(PRESETS[name].__dict__ | changes))


def preset_from(text: str, name: str = "vlnce") -> Preset:
    """A preset with the values that a JSON object gives; unknown ones are refused."""
    given = json.loads(text)
    return preset(given.pop("preset", name), **given)


def features(points: DataFrame, threshold: float = 0.1) -> DataFrame:
    """points with feature: start, end, turning or straight; null for paths of fewer than three points."""
    n = F.count("*").over(Window.partitionBy("path_id"))
    bend = F.abs(normalised(F.lead("yaw").over(_order()) - F.lag("yaw").over(_order())))
    place = F.row_number().over(_order())
    feature = F.when(n < 3, None).when(place == 1, "start").when(place == n, "end").when(bend > threshold, "turning").otherwise("straight")
    return points.withColumn("feature", feature)


def smart_sample(points: DataFrame, how: Preset = PRESETS["vlnce"]) -> DataFrame:
    """Keeps the ends, and of the others by place each turn_every-th turning and straight_every-th straight one."""
    rows = features(points, how.turn_threshold).withColumn("place", F.row_number().over(_order()) - 1)
    f, i = F.col("feature"), F.col("place")
    keep = f.isNull() | f.isin("start", "end") | ((f == "turning") & (i % how.turn_every == 0)) | ((f == "straight") & (i % how.straight_every == 0))
    return rows.where(keep).drop("place")


def uniform_sample(points: DataFrame) -> DataFrame:
    """Keeps min(max(15, n / 5), n) points at even places, each as often as it is picked."""
    n = F.count("*").over(Window.partitionBy("path_id"))
    rows = points.withColumns({"place": F.row_number().over(_order()) - 1, "n": n})
    k = F.least(F.greatest(F.lit(15), F.floor(F.col("n") / 5)), F.col("n"))
    rows = rows.withColumn("k", k)
    step = F.col("n") - 1
    # i is picked for a place p with floor(i * (n - 1) / (k - 1)) = p
    low = F.ceil(F.try_divide(F.col("place") * (F.col("k") - 1), step))
    high = F.ceil(F.try_divide((F.col("place") + 1) * (F.col("k") - 1), step)) - 1
    times = F.when(F.col("k") >= F.col("n"), 1).otherwise(F.least(high, F.col("k") - 1) - low + 1)
    return rows.where(times > 0).drop("place", "n", "k")


def stride_sample(points: DataFrame, k: int) -> DataFrame:
    """Each k-th point, from the first on."""
    return points.withColumn("place", F.row_number().over(_order()) - 1).where(F.col("place") % k == 0).drop("place")


def headings(points: DataFrame) -> DataFrame:
    """points with yaw toward the next one; 0 at the last."""
    nxt = lambda c: F.coalesce(F.lead(c).over(_order()), F.col(c))
    return points.withColumn("yaw", F.atan2(nxt("y") - F.col("y"), nxt("x") - F.col("x")))


def c_headings(points: DataFrame) -> DataFrame:
    """headings() by the C library's arctangent, which SQL engines use too.

    The JVM's may differ in the last bit.  That bit decides to which side a turn
    by exactly half a turn goes, and how many actions a turn by a whole number of
    them takes, so actions need the same one.
    """

    @F.arrow_udf("double")
    def angle(dy: pa.Array, dx: pa.Array) -> pa.Array:
        return pa.array([None if y is None or x is None else math.atan2(y, x) for y, x in zip(dy.to_pylist(), dx.to_pylist(), strict=True)], pa.float64())

    nxt = lambda c: F.coalesce(F.lead(c).over(_order()), F.col(c))
    by = points.withColumns({"dy": (nxt("y") - F.col("y")).cast("double"), "dx": (nxt("x") - F.col("x")).cast("double")})
    return by.withColumn("yaw", angle("dy", "dx")).drop("dy", "dx")


def _c_length(*by: pa.Array) -> pa.Array:
    """Root of the sum of squares, these by the C library's power."""
    squares = [pc.power(b, 2.0) for b in by]
    total = squares[0]
    for s in squares[1:]:
        total = pc.add(total, s)
    return pc.sqrt(total)


def c_lengths(points: DataFrame) -> DataFrame:
    """points with d, the distance to the next one (null at the last), by the C library's power, which SQL engines use too.

    It is not always the product rounded.  The last bit decides how many moves
    a distance by a whole number of them takes.
    """

    @F.arrow_udf("double")
    def length(dx: pa.Array, dy: pa.Array, dz: pa.Array) -> pa.Array:
        return _c_length(dx, dy, dz)

    by = {f"d{c}": (F.lead(c).over(_order()) - F.col(c)).cast("double") for c in "xyz"}
    return points.withColumns(by).withColumn("d", length(*by)).drop(*by)


def _turns(angle: Column, how: Preset) -> Column:
    """Turns of a leg by its angle; none where that is not known."""
    # bounded before the cast, which refuses what an int cannot hold
    return F.when(F.abs(angle) > MIN_TURN, F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.abs(angle) / math.radians(how.turn))).cast("int")).otherwise(0)


def _moves(rest: Column, how: Preset) -> Column:
    """Moves of a leg out of the distance gathered; as many as a leg may have where that is not known."""
    return F.least(F.lit(5.0), rest / how.move).cast("int")


def _left(rest: Column, moves: Column, how: Preset) -> Column:
    # subtracted one by one, as rounding then is that of a walk
    return F.aggregate(F.array_repeat(F.lit(how.move), moves), rest, lambda a, m: a - m)


def discretised(points: Column, how: Preset, measured: bool = False) -> Column:
    """array<string> of actions along points: turns, then moves out of the distance gathered, a last move, STOP.

    A path of fewer than two points only stops.  Where a distance is not known, as
    many moves are made as a leg may have, and the rest last known decides on the
    last move.  Legs after the one that reaches the most actions of the preset make
    none; counted() has those of the whole path.  measured: points have d, the
    distance to the next one.
    """
    cap = min(50, 2 * how.most)
    n = F.size(points)
    legs = F.zip_with(
        F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(
            (a["d"] if measured else F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]) + (b["z"] - a["z"]) * (b["z"] - a["z"]))).alias("d"),
            normalised(b["yaw"] - a["yaw"]).alias("turn"),
        ),
    )
    start = F.struct(F.array().cast("array<string>").alias("actions"), F.lit(0.0).alias("rest"), F.lit(0.0).alias("known"))

    def step(state: Column, leg: Column) -> Column:
        angle, rest = leg["turn"], state["rest"] + leg["d"]
        turns, moves = _turns(angle, how), _moves(rest, how)
        left = _left(rest, moves, how)
        name = F.when(angle > 0, F.lit("TURN_LEFT")).otherwise(F.lit("TURN_RIGHT"))
        done = F.concat(state["actions"], F.array_repeat(name, turns), F.array_repeat(F.lit("MOVE_FORWARD"), moves))
        go = F.struct(done.alias("actions"), left.alias("rest"), F.coalesce(left, state["known"]).alias("known"))
        return F.when(F.size(state["actions"]) >= cap, state).otherwise(go)

    def close(state: Column) -> Column:
        last = F.when(state["known"] > how.move * 0.5, F.array(F.lit("MOVE_FORWARD"))).otherwise(F.array().cast("array<string>"))
        return F.concat(state["actions"], last, F.array(F.lit("STOP")))

    return F.when(n < 2, F.array(F.lit("STOP"))).otherwise(F.aggregate(legs, start, step, close))


def counted(points: DataFrame, how: Preset) -> DataFrame:
    """(path_id, counts map<string, bigint>) of the actions along whole paths, however many they are.

    points: the long table with d, the distance to the next one, as c_lengths() has
    it.  The rules are those of discretised(), without its end at the most actions
    of the preset.  Turns are added up; only the distances are kept in path order.
    """
    nxt = lambda c: F.lead(c).over(_order())
    turn = normalised(nxt("yaw") - F.col("yaw"))
    leg = F.when(nxt("seq").isNotNull(), F.struct("seq", "d"))
    legs = points.select("path_id", turn.alias("turn"), leg.alias("leg")).withColumn("turns", _turns(F.col("turn"), how))
    sums = legs.groupBy("path_id").agg(
        F.sum(F.when(F.col("turn") > 0, F.col("turns")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("turn") > 0, 0).otherwise(F.col("turns"))).alias("right"),
        F.sort_array(F.collect_list("leg")).alias("legs"),
    )
    start = F.struct(F.lit(0).cast("long").alias("moves"), F.lit(0.0).alias("rest"), F.lit(0.0).alias("known"))

    def step(state: Column, leg: Column) -> Column:
        rest = state["rest"] + leg["d"]
        moves = _moves(rest, how)
        left = _left(rest, moves, how)
        return F.struct((state["moves"] + moves).alias("moves"), left.alias("rest"), F.coalesce(left, state["known"]).alias("known"))

    last = lambda state: state["moves"] + F.when(state["known"] > how.move * 0.5, 1).otherwise(0)
    found = {"TURN_LEFT": F.col("left"), "TURN_RIGHT": F.col("right"), "MOVE_FORWARD": F.aggregate("legs", start, step, last), "STOP": F.lit(1).cast("long")}
    counts = F.create_map(*(x for name, n in found.items() for x in (F.lit(name), n)))
    return sums.select("path_id", F.map_filter(counts, lambda _, n: n > 0).alias("counts"))


def as_arrays(points: DataFrame, *more: str) -> DataFrame:
    """(path_id, points array) of the long table, in path order; more: further columns of a point."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "x", "y", "z", "yaw", *more)))
    return points.groupBy("path_id").agg(ordered.alias("points"))


def interpolated(paths: DataFrame, how: Preset) -> DataFrame:
    """(path_id, actions, poses) of paths(path_id, points, actions): one pose [x, y, z, yaw] for each action.

    Between two points, poses are spread over the turns and moves of that leg;
    the last pose is repeated, or those before it go, to match the actions.  A path
    with as many points as actions has those; one without points has no poses.
    All legs of an Arrow batch are worked out at once.
    """
    def spread(sizes: np.ndarray) -> np.ndarray:
        """0, 1, ... within each run of so many."""
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def along(p: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Poses of all paths and the number of each; p: points (x, y, z, yaw), m of each path, for n actions."""
        first = np.cumsum(m) - m
        path = np.repeat(np.arange(len(m)), m)
        a = np.flatnonzero(path[:-1] == path[1:]) if len(path) else np.zeros(0, np.int64)
        one, two = p[a], p[a + 1]
        step = _c_length(*(pa.array(two[:, c] - one[:, c]) for c in range(3))).to_numpy()  # as c_lengths() has it
        turn = two[:, 3] - one[:, 3]  # as normalised() rounds it
        with np.errstate(invalid="ignore"):
            turn = np.abs(np.where(turn > math.pi, turn - 2 * math.pi * np.ceil((turn - math.pi) / (2 * math.pi)), np.where(turn < -math.pi, turn + 2 * math.pi * np.ceil((-math.pi - turn) / (2 * math.pi)), turn)))
        turns = np.where(turn > MIN_TURN, np.clip((turn / math.radians(how.turn)).astype(int), 1, 4), 0)
        parts = np.maximum(turns + np.minimum(5, (step / how.move).astype(int)), 1)
        leg, j = np.repeat(np.arange(len(a)), parts), spread(parts)
        t = j / parts[leg]
        one, two = one[leg], two[leg]
        dot = np.cos((two[:, 3] - one[:, 3]) / 2)
        theta, sign = np.arccos(np.minimum(np.abs(dot), 1)), np.where(dot < 0, -1.0, 1.0)
        near = np.abs(dot) > 0.9995
        under = np.where(near, 1, np.sin(theta))
        u, v = np.where(near, 1 - t, np.sin((1 - t) * theta) / under), np.where(near, t, np.sin(t * theta) / under) * sign
        yaw = 2 * np.arctan2(u * np.sin(one[:, 3] / 2) + v * np.sin(two[:, 3] / 2), u * np.cos(one[:, 3] / 2) + v * np.cos(two[:, 3] / 2))
        full = np.column_stack([one[:, :3] + (two[:, :3] - one[:, :3]) * t[:, None], np.where(j == 0, one[:, 3], yaw)])
        made = np.bincount(path[a], weights=parts, minlength=len(m)).astype(np.int64)
        out = np.where(m > 0, n, 0)
        own, i = np.repeat(np.arange(len(m)), out), spread(out)
        plain = (m < 2) | (n == m)
        poses = p[(first + m - 1)[own]] if len(own) else np.zeros((0, 4))
        hit = plain[own] & (i < m[own])
        poses[hit] = p[(first[own] + i)[hit]]
        hit = ~plain[own] & (i < np.minimum(made, n - 1)[own])
        poses[hit] = full[((np.cumsum(made) - made)[own] + i)[hit]]
        return poses, out

    def run(batches):
        for batch in batches:
            points, acts = batch.column(1), batch.column(2)
            m, n = (np.nan_to_num(pc.list_value_length(x).to_numpy(zero_copy_only=False)).astype(np.int64) for x in (points, acts))
            flat = points.flatten()
            p = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "z", "yaw")]) if len(flat) else np.zeros((0, 4))
            poses, sizes = along(p, m, n)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(poses) + 1, 4), pa.int32()), pa.array(poses.reshape(-1)))
            outer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), acts, outer], names=["path_id", "actions", "poses"])

    kind = paths.schema["path_id"].dataType.simpleString()
    at = lambda p: F.struct(*(p[c].cast("double").alias(c) for c in ("x", "y", "z", "yaw")))
    return paths.select("path_id", F.transform("points", at).alias("points"), "actions").mapInArrow(run, f"path_id {kind}, actions array<string>, poses array<array<double>>")


def action_breakdown(paths: DataFrame) -> DataFrame:
    """(action, n, share, per_path) over paths(path_id, counts), as counted() has them."""
    n_paths = paths.agg(F.count("*").alias("paths"))
    each = paths.select(F.explode("counts").alias("action", "k")).groupBy("action").agg(F.sum("k").alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    return each.join(F.broadcast(total)).join(F.broadcast(n_paths)).select("action", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.col("paths")).alias("per_path"))


def contiguous_frames(frames: DataFrame) -> DataFrame:
    """frames(video_id, pos, frame, there) up to the first that is not there, as arrays (video_id, frames)."""
    first = F.min(F.when(~F.col("there"), F.col("pos"))).over(Window.partitionBy("video_id"))
    kept = frames.withColumn("cut", first).where(F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
    return kept.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "frame"))), lambda x: x["frame"]).alias("frames"))


def training_windows(videos: DataFrame) -> DataFrame:
    """(video_id, step, frames, action) of videos(video_id, frames, actions): each action with all frames up to it.

    Both arrays are cut to the shorter one.
    """
    n = F.least(F.size("frames"), F.size("actions"))
    cut = videos.withColumns({"actions": F.slice("actions", 1, F.greatest(n, F.lit(0))), "all_frames": F.col("frames")})
    each = cut.select("video_id", "all_frames", F.posexplode("actions").alias("step", "action"))
    return each.select("video_id", "step", F.slice("all_frames", 1, F.col("step") + 1).alias("frames"), "action")


def history(frames: DataFrame, n: int = 8) -> DataFrame:
    """frames(video_id, pos, frame) with the last n, the oldest repeated in front where there are fewer."""
    seen = F.collect_list("frame").over(Window.partitionBy("video_id").orderBy("pos").rowsBetween(1 - n, 0))
    return frames.withColumn("history", F.concat(F.array_repeat(F.element_at(seen, 1), F.lit(n) - F.size(seen)), seen))
