"""Column expressions on positions, angles, quaternions and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TAU = math.pi, 2 * math.pi


def distance(*pairs: tuple[Column, Column]) -> Column:
    """Euclidean distance; one pair of columns for each axis."""
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs), F.lit(0.0)))


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def to_pixel(v: Column, low: Column | float, scale: float) -> Column:
    """World coordinate to pixel, half to even."""
    return F.bround((v - low) / scale).cast("int")


def to_world(p: Column, low: Column | float, scale: float) -> Column:
    """Centre of a pixel."""
    return low + (p + 0.5) * scale


def clipped_pixel(v: Column, low: Column | float, scale: float, size: int) -> Column:
    """World coordinate to the pixel below it, within the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((v - low) / scale))).cast("int")


def coarse_cell(v: Column, size: float = 0.5) -> Column:
    """Cell of a coordinate, truncated toward zero."""
    return (v / size).cast("int")


def grid_size(low: Column, high: Column, scale: float) -> Column:
    return (F.ceil((high - low) / scale) + 1).cast("int")


def mirrored(v: Column, low: Column, high: Column, flip: bool = True, negate: bool = True) -> Column:
    """Map coordinate to scene coordinate: mirrored within the bounds, then negated."""
    v = (low + high) - v if flip else v
    return -v if negate else v


def unmirrored(v: Column, low: Column, high: Column, flip: bool = True, negate: bool = True) -> Column:
    """Inverse of mirrored()."""
    v = -v if negate else v
    return (low + high) - v if flip else v


def yaw(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """Heading of a quaternion about z."""
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def scene_yaw(qx: Column, qw: Column) -> Column:
    """Heading of a pose in the scene's convention, which turns about x."""
    return 2 * F.atan2(-qx, qw)


def quaternion(angle: Column) -> Column:
    """[x, y, z, w] of a heading."""
    return F.array(F.lit(0.0), F.lit(0.0), F.sin(angle / 2), F.cos(angle / 2))


def wrapped_once(angle: Column) -> Column:
    return F.when(angle > PI, angle - TAU).when(angle < -PI, angle + TAU).otherwise(angle)


def normalised(angle: Column) -> Column:
    """Angle in [-pi, pi]; both ends stay."""
    return F.when(angle > PI, angle - TAU * F.ceil((angle - PI) / TAU)).when(angle < -PI, angle + TAU * F.ceil((-PI - angle) / TAU)).otherwise(angle)


def turned(angle: Column, by: Column) -> Column:
    """Heading after a turn, in [-pi, pi)."""
    return F.pmod(angle + by + PI, F.lit(TAU)) - PI


def start_yaw(qx: Column, qw: Column) -> Column:
    """Start heading of an episode: the pose's, turned by half a turn."""
    return wrapped_once(scene_yaw(qx, qw) - PI)


def scene_poses(points: Column, x0: Column, x1: Column, y0: Column, y1: Column, flip_x: bool = True, flip_y: bool = True, negate: bool = True) -> Column:
    """Planner poses array<struct<x, y, z, qx, qy, qz, qw>> in the scene's convention.

    Positions are mirrored and negated, headings turned by half a turn; the last
    pose has no rotation.
    """

    def pose(p: Column, i: Column) -> Column:
        angle = wrapped_once(yaw(p["qx"], p["qy"], p["qz"], p["qw"]) + PI)
        last = i == F.size(points) - 1
        keep = lambda a, b: F.when(last, F.lit(a)).otherwise(b)
        return F.struct(
            mirrored(p["x"], x0, x1, flip_x, negate).alias("x"), mirrored(p["y"], y0, y1, flip_y, negate).alias("y"), p["z"].alias("z"),
            keep(0.0, -F.sin(angle / 2)).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), keep(1.0, F.cos(angle / 2)).alias("qw"),
        )

    return F.transform(points, pose)


def body_to_world(vx: Column, vy: Column, angle: Column) -> tuple[Column, Column]:
    return vx * F.cos(angle) - vy * F.sin(angle), vx * F.sin(angle) + vy * F.cos(angle)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Shortest-arc interpolation of two quaternions (arrays); linear if they are nearly equal."""
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  evaluates value once
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    unit = lambda q: let(F.sqrt(dot(q, q)), lambda n: F.transform(q, lambda x: F.when(n > 0, F.try_divide(x, n)).otherwise(x)))
    blend = lambda p, q, u, v: F.zip_with(p, q, lambda x, y: x * u + y * v)

    def arc(p: Column, q: Column, d: Column) -> Column:
        theta = F.acos(F.least(d, F.lit(1.0)))
        curved = blend(p, q, F.try_divide(F.sin((1 - t) * theta), F.sin(theta)), F.try_divide(F.sin(t * theta), F.sin(theta)))
        return F.when(d > 0.9995, unit(blend(p, q, 1 - t, t))).otherwise(curved)

    def short(p: Column, q: Column) -> Column:
        return let(dot(p, q), lambda d: arc(p, F.transform(q, lambda x: F.when(d < 0, -x).otherwise(x)), F.abs(d)))

    return let(unit(a), lambda p: let(unit(b), lambda q: short(p, q)))


def box_centre(box: Column) -> Column:
    """Centre [x, y] of a box [x0, y0, x1, y1]; null unless it has four values."""
    return F.when(F.size(box) == 4, F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2))


def in_box(x: Column, y: Column, box: Column, by: float | Column) -> Column:
    """Within a box that is expanded on all sides; false unless it has four values."""
    inside = (x >= box[0] - by) & (x <= box[2] + by) & (y >= box[1] - by) & (y <= box[3] + by)
    return F.when(F.size(box) == 4, inside).otherwise(False)


def corners_box(corners: Column) -> Column:
    """struct<x0, y0, z0, x1, y1, z1> of corner structs; null if there are none or a value is missing."""
    axis = lambda a: F.transform(corners, lambda p: p[a])
    good = (F.size(corners) > 0) & F.forall(corners, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    box = F.struct(*(f(axis(a)).alias(f"{a}{k}") for k, f in enumerate((F.array_min, F.array_max)) for a in "xyz"))
    return F.when(good, box)


def covered(x: Column, y: Column, ring: Column) -> Column:
    """The polygon of ring (array of struct x, y) covers the point, its border included."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (F.abs(cross) < 1e-12) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def right(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])

    return F.exists(edges, on) | (F.size(F.filter(edges, right)) % 2 == 1)
