"""Occupancy grids: rasterised footprints, inflation, components, boundaries, paths and collisions.

grid(scene_id, row, col, v) is the long form of a grayscale image; scenes have
their own extent (x0, y0, scale, h, w).  What needs a whole grid at once runs
per scene, whose grid has a bounded size; many requests of one scene are split,
each part with the grid as bits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import covered, grid_size, to_pixel, unmirrored
from ..functions.text import normalised_label

#: Radii in metres, least area of an unusable area, wall height, obstacle labels.
PLANNER_RADIUS, LEAST_AREA, WALL_HEIGHT, TOLERANCE = 0.2, 5, 3.0, 2
OBSTACLES = ["wall", "unable area"]
#: Labels with a fixed category, from 1 on.
CLASSES = ["door", "window", "chair", "table", "sofa", "bed", "wardrobe", "plant", "floor", "wall", "ceiling"]
#: Path requests and moves of a scene that go to one task.
REQUESTS, MOVES = 200, 50_000
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def pixel_histogram(grid: DataFrame) -> DataFrame:
    return grid.groupBy("scene_id", "v").agg(F.count("*").alias("n"))


def wall_value(grid: DataFrame) -> DataFrame:
    """(scene_id, wall): the most frequent value over 0 and under 250, the smallest of equals; else the smallest value."""
    h = pixel_histogram(grid)
    common = F.max(F.when((F.col("v") > 0) & (F.col("v") < 250), F.struct("n", (-F.col("v")).alias("m"))))
    return h.groupBy("scene_id").agg(F.coalesce(-common["m"], F.min("v")).alias("wall"))


def rasterised(objects: DataFrame) -> DataFrame:
    """(scene_id, pos, label, row, col) of cells whose centres objects(scene_id, pos, label, ring, x0, y0, scale, h, w) cover.

    Cells are flipped on both axes, as maps of objects are.
    """
    axis = lambda a: F.transform("ring", lambda p: p[a])

    def span(values: Column, low: str, size: str) -> Column:
        at = lambda v: F.greatest(F.lit(0), F.least(F.col(size) - 1, F.floor((v - F.col(low)) / F.col("scale"))))
        return F.sequence(at(F.array_min(values)), at(F.array_max(values)))

    cells = objects.withColumn("j", F.explode(span(axis("x"), "x0", "w"))).withColumn("i", F.explode(span(axis("y"), "y0", "h")))
    cx, cy = F.col("x0") + (F.col("j") + 0.5) * F.col("scale"), F.col("y0") + (F.col("i") + 0.5) * F.col("scale")
    kept = cells.where(covered(cx, cy, F.col("ring")))
    return kept.select("scene_id", "pos", "label", (F.col("h") - 1 - F.col("i")).cast("int").alias("row"), (F.col("w") - 1 - F.col("j")).cast("int").alias("col"))


def flipped_rows(grid: DataFrame, height: str = "h") -> DataFrame:
    """Walls and unusable areas are flipped on the vertical axis only."""
    return grid.withColumn("row", F.col(height) - 1 - F.col("row"))


def mask_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., area, row0, row1, col0, col1, coords): coords in row-major order."""
    return cells.groupBy(*keys).agg(F.count("*").alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.sort_array(F.collect_list(F.struct("row", "col"))).alias("coords"))


def labelled(rows: np.ndarray, cols: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Component of each of different cells, from 1 on in the order of the first cell by rows and columns.

    Labels are hooked to the smallest of a neighbour and followed to their roots, for all cells at once.
    """
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    width = int(cols.max() - cols.min()) + 3
    key = (rows - rows.min()).astype(np.int64) * width + (cols - cols.min())
    order = np.argsort(key, kind="stable")
    key = key[order]
    one, two = [], []
    for dr, dk in offsets:
        if (dr, dk) > (0, 0):
            at = np.searchsorted(key, key + dr * width + dk)
            at[at == len(key)] = 0
            hit = np.flatnonzero(key[at] == key + dr * width + dk)
            one.append(hit)
            two.append(at[hit])
    a, b = np.concatenate(one), np.concatenate(two)
    label = np.arange(len(key))
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    found = np.empty(len(key), dtype=np.int64)
    found[order] = np.unique(label, return_inverse=True)[1] + 1
    return found


def components(cells: DataFrame, diagonal: bool) -> DataFrame:
    """(scene_id, row, col, component) of cells(scene_id, row, col): connected by sides, or by corners too.

    A scene's cells, which its image bounds, are one task's.
    """
    offsets = EIGHT if diagonal else FOUR
    kind = cells.schema["scene_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return table.append_column("component", pa.array(labelled(table["row"].to_numpy(), table["col"].to_numpy(), offsets)))

    rows = cells.select("scene_id", F.col("row").cast("long"), F.col("col").cast("long")).where("scene_id is not null and row is not null and col is not null").distinct()
    return rows.groupBy("scene_id").applyInArrow(run, f"scene_id {kind}, row long, col long, component long")


def area_instances(cells: DataFrame, label: str, height: float, least: int = 1) -> DataFrame:
    """(scene_id, label, instance_id, item_id, height, area, row0, row1, col0, col1, coords) of the components of cells.

    instance_id counts all components, item_id those of at least so many cells.
    """
    m = mask_summary(components(cells, True), ["scene_id", "component"]).where(F.col("area") >= least)
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy("component"))
    name = F.lit(label)
    stem = normalised_label(name)
    return m.select("scene_id", name.alias("label"), F.concat_ws("_", stem, F.col("component").cast("string")).alias("instance_id"), F.concat_ws("_", stem, place.cast("string")).alias("item_id"), F.lit(height).alias("height"), "area", "row0", "row1", "col0", "col1", "coords")


def category_ids(labels: DataFrame) -> DataFrame:
    """(scene_id, label, category_id) of labels(scene_id, pos, label): fixed ones from 1 on, others after them in the order of their first place."""
    known = F.create_map(*(F.lit(x) for k, n in enumerate(CLASSES, 1) for x in (n, k)))
    seen = labels.groupBy("scene_id", "label").agg(F.min("pos").alias("first")).withColumn("known", F.try_element_at(known, F.col("label")))
    new = F.row_number().over(Window.partitionBy("scene_id", F.col("known").isNull()).orderBy("first", "label")) + len(CLASSES)
    return seen.select("scene_id", "label", F.coalesce("known", new).alias("category_id"))


def semantic_map(objects: DataFrame, grid: DataFrame, extent: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Instances of objects(scene_id, pos, label, ring, z0, z1), walls and unusable areas (value 0) of
    grid(scene_id, row, col, v), with extent(scene_id, x0, y0, scale, h, w): category, box in metres, area, heights and
    coords, the centres [y, x] of its cells in metres.

    labels(scene_id, pos, label): all annotations that categories are numbered by, those without a ring too; else the
    objects.  ins_id of objects, if there, is their instance_id.
    """
    e = F.broadcast(extent) if extent.isLocal() else extent
    own = mask_summary(rasterised(objects.join(e, "scene_id")), ["scene_id", "pos", "label"])
    # numbered among those that cover a cell
    place = F.row_number().over(Window.partitionBy("scene_id", "label").orderBy("pos"))
    own = own.withColumn("item_id", F.concat_ws("_", normalised_label(F.col("label")), place.cast("string")))
    ins = F.coalesce(F.col("ins_id"), F.lit("")) if "ins_id" in objects.columns else F.lit("")
    own = own.join(objects.select("scene_id", "pos", ins.alias("instance_id"), (F.col("z1") - F.col("z0")).alias("height"), "z0", "z1"), ["scene_id", "pos"])
    own = own.join(category_ids(labels if labels is not None else objects), ["scene_id", "label"])
    own = own.select("scene_id", "category_id", "label", "instance_id", "item_id", "height", "z0", "z1", "area", "row0", "row1", "col0", "col1", "coords")
    up = flipped_rows(grid.join(extent.select("scene_id", "h"), "scene_id"))
    on_floor = {"z0": F.lit(0.0), "z1": F.col("height")}
    walls = area_instances(up.join(wall_value(grid), "scene_id").where("v = wall"), "wall", WALL_HEIGHT).withColumns(on_floor | {"category_id": F.lit(CLASSES.index("wall") + 1)})
    unable = area_instances(up.where("v = 0"), "Unable Area", 0.0, LEAST_AREA).withColumns(on_floor | {"category_id": F.lit(-1)})
    own = own.withColumn("coords", F.transform("coords", lambda c: F.struct(c["row"].cast("long").alias("row"), c["col"].cast("long").alias("col"))))
    out = own.unionByName(walls).unionByName(unable).join(e, "scene_id")
    x = lambda c, add: F.col("x0") + (F.col(c) + add) * F.col("scale")
    y = lambda c, add: F.col("y0") + (F.col(c) + add) * F.col("scale")
    centre = lambda low, c: F.col(low) + (c + 0.5) * F.col("scale")
    coords = F.transform("coords", lambda c: F.array(centre("y0", c["row"]), centre("x0", c["col"])))
    box = F.array(x("col0", 0), y("row0", 0), x("col1", 1), y("row1", 1))
    return out.select("scene_id", "category_id", "label", "instance_id", "item_id", "height", "z0", "z1", "area", box.alias("box"), coords.alias("coords"))


def disk(radius: float, scale: float) -> list[tuple[int, int]]:
    """Offsets of cells within the radius, its border included."""
    r = (radius / scale) ** 2 + 1e-9
    k = math.floor(radius / scale + 1e-9)
    return [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if i * i + j * j <= r]


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs))


def inflated(cells: DataFrame, radius: float = PLANNER_RADIUS, scale: float = 0.05, by: str = "scene_id") -> DataFrame:
    """Cells within the radius of obstacle cells(by, row, col), those included."""
    spread = cells.select(by, "row", "col").withColumn("o", F.explode(_offsets(disk(radius, scale))))
    return spread.select(by, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).distinct()


def map_extent(instances: DataFrame, scale: float = 0.05) -> DataFrame:
    """(scene_id, x0, y0, scale, h, w) of the grid that the coords ([y, x] in metres) of all instances(scene_id, coords) span."""
    at = instances.select("scene_id", F.explode("coords").alias("c")).where(F.col("c")[0].isNotNull() & F.col("c")[1].isNotNull())
    y, x = F.col("c")[0], F.col("c")[1]
    ends = at.groupBy("scene_id").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return ends.select("scene_id", "x0", "y0", F.lit(scale).alias("scale"), grid_size(F.col("y0"), F.col("y1"), scale).alias("h"), grid_size(F.col("x0"), F.col("x1"), scale).alias("w"))


def mask_cells(instances: DataFrame, extent: DataFrame) -> DataFrame:
    """(scene_id, item_id, row, col): the cells of extent() that the coords of instances(scene_id, item_id, coords) lie nearest to."""
    at = instances.select("scene_id", "item_id", F.explode("coords").alias("c")).join(extent, "scene_id")
    near = lambda k, low: F.bround((F.col("c")[k] - F.col(low)) / F.col("scale")).cast("int")
    found = at.select("scene_id", "item_id", near(0, "y0").alias("row"), near(1, "x0").alias("col"), "h", "w")
    return found.where("row >= 0 and row < h and col >= 0 and col < w").drop("h", "w").distinct()


def obstacles(instances: DataFrame) -> DataFrame:
    """Of instances(label, ...) those that block the way."""
    return instances.where(F.lower("label").isin(OBSTACLES))


def obstacle_cells(instances: DataFrame, extent: DataFrame, radius: float = PLANNER_RADIUS, scale: float = 0.05) -> DataFrame:
    """(scene_id, row, col) within the radius of walls and unusable areas of instances(scene_id, label, item_id, coords), inside the grid."""
    near = inflated(mask_cells(obstacles(instances), extent).select("scene_id", "row", "col").distinct(), radius, scale)
    return near.join(extent.select("scene_id", "h", "w"), "scene_id").where("row >= 0 and row < h and col >= 0 and col < w").drop("h", "w")


def boundary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a mask that have a side neighbour outside it."""
    sides = cells.withColumn("o", F.explode(_offsets(FOUR))).select(*keys, "row", "col", (F.col("row") + F.col("o.i")).alias("r2"), (F.col("col") + F.col("o.j")).alias("c2"))
    mask = cells.select(*keys, F.col("row").alias("r2"), F.col("col").alias("c2"))
    return sides.join(mask, [*keys, "r2", "c2"], "left_anti").select(*keys, "row", "col").distinct()


def centroids(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cell of a mask, half to even."""
    return cells.groupBy(*keys).agg(F.bround(F.avg("row")).cast("int").alias("row"), F.bround(F.avg("col")).cast("int").alias("col"))


def collision_info(grid: DataFrame) -> DataFrame:
    """(scene_id, obstacles, cells, ratio) of grid(scene_id, row, col, blocked)."""
    return grid.groupBy("scene_id").agg(F.sum(F.col("blocked").cast("long")).alias("obstacles"), F.count("*").alias("cells"), F.avg(F.col("blocked").cast("double")).alias("ratio"))


def point_collisions(points: DataFrame, blocked: DataFrame, extent: DataFrame) -> DataFrame:
    """points(scene_id, point_id, x, y in scene coordinates) with collided, by blocked(scene_id, row, col) and
    extent(scene_id, x0, x1, y0, y1, scale, h, w).

    Up to two cells outside the grid count as its border cell, beyond is a collision.
    """
    p = points.join(extent, "scene_id")
    mx = unmirrored(F.col("x"), F.col("x0"), F.col("x1"))
    my = unmirrored(F.col("y"), F.col("y0"), F.col("y1"))
    p = p.withColumns({"px": F.bround((mx - F.col("x0")) / F.col("scale")).cast("int"), "py": F.bround((my - F.col("y0")) / F.col("scale")).cast("int")})
    out = lambda c, size: (F.col(c) < -TOLERANCE) | (F.col(c) >= F.col(size) + TOLERANCE)
    p = p.withColumn("outside", out("px", "w") | out("py", "h"))
    hold = lambda c, size: F.greatest(F.lit(0), F.least(F.col(size) - 1, F.col(c)))
    p = p.withColumns({"row": hold("py", "h"), "col": hold("px", "w")})
    hits = blocked.select("scene_id", "row", "col").distinct().withColumn("hit", F.lit(True))
    found = p.join(hits, ["scene_id", "row", "col"], "left")
    return found.select(*points.columns, (F.col("outside") | F.coalesce("hit", F.lit(False))).alias("collided"))


def path_collisions(moves: DataFrame, blocked: DataFrame, extent: DataFrame, n: int = 10) -> DataFrame:
    """(scene_id, move_id, collided) of moves(scene_id, move_id, x1, y1, x2, y2): any of n points on the way, the start left out."""
    k = F.col("k") / n
    at = moves.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("scene_id", F.col("move_id").alias("point_id"), (F.col("x1") + (F.col("x2") - F.col("x1")) * k).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * k).alias("y"))
    return point_collisions(at, blocked, extent).groupBy("scene_id", F.col("point_id").alias("move_id")).agg(F.bool_or("collided").alias("collided"))


def search(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> tuple[float, list[tuple[int, int]]]:
    """Cost and cells of a shortest path over free cells, by sides and corners; (inf, []) without one."""
    h, w = free.shape
    inside = lambda c: 0 <= c[0] < h and 0 <= c[1] < w and free[c]
    if not inside(start) or not inside(goal):
        return math.inf, []
    best, came = {start: 0.0}, {}
    queue = [(math.dist(start, goal), start)]
    done = set()
    while queue:
        _, c = heapq.heappop(queue)
        if c == goal:
            path = [c]
            while c in came:
                c = came[c]
                path.append(c)
            return best[goal], path[::-1]
        if c in done:
            continue
        done.add(c)
        for dr, dk in EIGHT:
            near = (c[0] + dr, c[1] + dk)
            if inside(near) and (cost := best[c] + math.hypot(dr, dk)) < best.get(near, math.inf) - 1e-12:
                best[near], came[near] = cost, c
                heapq.heappush(queue, (cost + math.dist(near, goal), near))
    return math.inf, []


def nearest_free(free: np.ndarray, mask: list[tuple[int, int]], toward: tuple[float, float] | None = None, most: int = 50) -> tuple[int, int] | None:
    """The free cell nearest to the mask's border, by sides, at most so many steps away; the least of equals.

    toward: only cells on that side of the mask's middle, if there are any.
    """
    h, w = free.shape
    own = set(mask)
    middle = np.mean(mask, axis=0)
    edge = sorted(c for c in own if any((c[0] + a, c[1] + b) not in own for a, b in FOUR))
    side = lambda c: toward is None or float(np.dot(np.subtract(c, middle), np.subtract(toward, middle))) >= 0
    seen, ring, second = set(edge), edge, None
    for _ in range(most + 1):
        for c in sorted(ring):
            if 0 <= c[0] < h and 0 <= c[1] < w and free[c]:
                if side(c):
                    return c
                second = second or c
        nxt = []
        for r, k in ring:
            for a, b in FOUR:
                near = (r + a, k + b)
                if near not in seen and -1 <= near[0] <= h and -1 <= near[1] <= w:
                    seen.add(near)
                    nxt.append(near)
        ring = nxt
    return second


def bitmaps(blocked: DataFrame) -> DataFrame:
    """(scene_id, row0, col0, high, wide, bits) of blocked(scene_id, row, col): one bit for each cell of the box that they span."""
    kind = blocked.schema["scene_id"].dataType.simpleString()

    def run(key, table):
        row, col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        low = row.min(), col.min()
        grid = np.zeros((row.max() - low[0] + 1, col.max() - low[1] + 1), dtype=bool)
        grid[row - low[0], col - low[1]] = True
        own = [key[0].as_py(), int(low[0]), int(low[1]), *grid.shape, np.packbits(grid).tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(own, [key[0].type, *[pa.int64()] * 4, pa.binary()], strict=True)], names=["scene_id", "row0", "col0", "high", "wide", "bits"])

    cells = blocked.select("scene_id", F.col("row").cast("long"), F.col("col").cast("long")).where("scene_id is not null and row is not null and col is not null").distinct()
    return cells.groupBy("scene_id").applyInArrow(run, f"scene_id {kind}, row0 long, col0 long, high long, wide long, bits binary")


class Bitmap:
    """A scene's blocked cells; free outside of their box."""

    def __init__(self, table: pa.Table):
        self.grid, self.low = np.zeros((1, 1), dtype=bool), (0, 0)
        if table.num_rows:
            r = table.slice(0, 1).to_pylist()[0]
            if r["bits"] is not None:
                n = r["high"] * r["wide"]
                self.grid = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=n).astype(bool).reshape(r["high"], r["wide"])
                self.low = r["row0"], r["col0"]

    def taken(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        r, c = row - self.low[0], col - self.low[1]
        inside = (r >= 0) & (r < self.grid.shape[0]) & (c >= 0) & (c < self.grid.shape[1])
        return inside & self.grid[np.where(inside, r, 0), np.where(inside, c, 0)]

    def free(self, h: int, w: int) -> np.ndarray:
        """The cells of an h x w grid that are not blocked."""
        out = np.ones((h, w), dtype=bool)
        r, c = np.nonzero(self.grid)
        r, c = r + self.low[0], c + self.low[1]
        inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        out[r[inside], c[inside]] = False
        return out


def _dealt(rows: DataFrame, key: str, size: int, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and grids by (scene_id, bucket): about size rows of a scene in each bucket, and its grid, one row, with them."""
    n = rows.groupBy("scene_id").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    dealt = rows.join(n, "scene_id").withColumn("bucket", F.pmod(F.xxhash64(key), "n").cast("int")).drop("n")
    return dealt, grids.join(n, "scene_id").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def planned_paths(requests: DataFrame, blocked: DataFrame, extent: DataFrame) -> DataFrame:
    """(scene_id, pair_id, cost, cells) of the shortest paths for requests(scene_id, pair_id, start array<struct<row, col>>,
    goal) of masks, over the cells of extent(scene_id, h, w) that blocked(scene_id, row, col) leaves free.  cost is null without a path.

    A path goes from the free cell nearest to the start mask on the goal's side
    to that nearest to the goal mask.  A scene's requests are dealt out REQUESTS
    at a time, each lot with the scene's grid as bits.
    """
    kind = requests.schema["scene_id"].dataType.simpleString()
    pair = requests.schema["pair_id"].dataType.simpleString()
    grids = extent.select("scene_id", "h", "w").join(bitmaps(blocked), "scene_id", "left")

    def run(left, right):
        out = []
        if right.num_rows:
            size = right.slice(0, 1).to_pylist()[0]
            free = Bitmap(right).free(size["h"], size["w"])
            for r in left.select(["scene_id", "pair_id", "start", "goal"]).to_pylist():
                masks = [[(c["row"], c["col"]) for c in m or []] for m in (r["start"], r["goal"])]
                ends = [nearest_free(free, masks[k], tuple(np.mean(masks[1 - k], axis=0))) for k in (0, 1)] if all(masks) else [None, None]
                cost, path = search(free, *ends) if all(e is not None for e in ends) else (math.inf, [])
                out.append((r["scene_id"], r["pair_id"], None if math.isinf(cost) else cost, [{"row": int(a), "col": int(b)} for a, b in path]))
        kinds = [left.schema.field("scene_id").type, left.schema.field("pair_id").type, pa.float64(), pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32())]))]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["scene_id", "pair_id", "cost", "cells"])

    schema = f"scene_id {kind}, pair_id {pair}, cost double, cells array<struct<row:int,col:int>>"
    left, right = _dealt(requests, "pair_id", REQUESTS, grids)
    return left.groupBy("scene_id", "bucket").cogroup(right.groupBy("scene_id", "bucket")).applyInArrow(run, schema)


def connected_items(items: DataFrame, parts: DataFrame) -> DataFrame:
    """(scene_id, item_id, component) of items(scene_id, item_id, row, col) on parts(scene_id, row, col, component); items are connected if they agree in it."""
    return items.join(parts, ["scene_id", "row", "col"]).select("scene_id", "item_id", "component").distinct()


def connected(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of pairs(scene_id, start, end) those whose items have a component of connected_items() in common."""
    one = members.select("scene_id", F.col("item_id").alias("start"), "component")
    two = members.select("scene_id", F.col("item_id").alias("end"), "component")
    return pairs.join(one, ["scene_id", "start"]).join(two, ["scene_id", "end", "component"]).select(*pairs.columns).distinct()


def nearest_cell(x: Column, y: Column, x0: float, y0: float, scale: float) -> tuple[Column, Column]:
    """(row, col) of a position."""
    return to_pixel(y, y0, scale), to_pixel(x, x0, scale)


def safe_moves(moves: DataFrame, blocked: DataFrame, scale: float, step: float = 0.01, most: float = 0.20, probe: float = 0.005, aside: float = 0.05) -> DataFrame:
    """(scene_id, move_id, x, y, moved) of moves(scene_id, move_id, x, y, dx, dy): steps of 1 cm, up to 20 cm, while the cell is free;
    if not even the first is, the nearest free place up to 5 cm to one of four sides.

    A scene's moves are dealt out MOVES at a time, each lot with the scene's grid
    as bits, and walk together.  A move with a null stays null.
    """
    kinds = {c: moves.schema[c].dataType.simpleString() for c in ("scene_id", "move_id")}

    def run(left, right):
        walls = Bitmap(right)
        x, y, dx, dy = (left[c].cast(pa.float64()).to_numpy(zero_copy_only=False) if not left[c].null_count else np.array([np.nan if v is None else v for v in left[c].to_pylist()], dtype=float) for c in ("x", "y", "dx", "dy"))
        known = np.isfinite(x + y + dx + dy)
        cell = lambda v: np.rint(np.where(known, v, 0) / scale).astype(np.int64)
        taken = lambda a, b: walls.taken(cell(b), cell(a))
        d = np.hypot(dx, dy)
        go = known & (d > 0)
        ux, uy = (np.divide(v, d, out=np.zeros(len(d)), where=go) for v in (dx, dy))
        n = np.where(go, (np.minimum(np.where(go, d, 0), most) / step + 1e-9).astype(np.int64), 0)
        k, open_ = np.zeros(len(d), dtype=np.int64), n > 0
        for i in range(1, int(n.max(initial=0)) + 1):
            open_ &= (i <= n) & ~taken(x + ux * step * i, y + uy * step * i)
            k[open_] = i
        nx, ny = x + ux * step * k, y + uy * step * k
        stuck = (n > 0) & (k == 0)
        for i in range(1, round(aside / probe) + 1):
            for a, b in ((-uy, ux), (uy, -ux), (ux, uy), (-ux, -uy)):
                if not stuck.any():
                    break
                tx, ty = x + a * probe * i, y + b * probe * i
                hit = stuck & ~taken(tx, ty)
                nx[hit], ny[hit] = tx[hit], ty[hit]
                stuck &= ~hit
        none = lambda v: pa.array(v, pa.float64(), mask=~known)
        return pa.table([left["scene_id"], left["move_id"], none(nx), none(ny), none(np.hypot(nx - x, ny - y))], names=["scene_id", "move_id", "x", "y", "moved"])

    left, right = _dealt(moves.select("scene_id", "move_id", "x", "y", "dx", "dy"), "move_id", MOVES, bitmaps(blocked))
    return left.groupBy("scene_id", "bucket").cogroup(right.groupBy("scene_id", "bucket")).applyInArrow(run, f"scene_id {kinds['scene_id']}, move_id {kinds['move_id']}, x double, y double, moved double")
