"""Queries on grids and paths.

Analogy: a scene is an event type, its obstacle cells are (props.k, value) of
its events on a 100 x 100 grid, and points are events with k mirrored.  Where
parts of a grid are told apart, a scene is a user, on a 10 x 10 grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from .catalogue import query, table

CELLS = "c AS (SELECT DISTINCT event_type AS scene_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS row, CAST(floor(least(value, 99)) AS INTEGER) AS col FROM events)"
PATCHES = "c AS (SELECT DISTINCT user_id AS scene_id, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS row, CAST(floor(least(value, 99)) AS INTEGER) // 10 AS col FROM events)"
H = W = 100
DISK = "d AS (SELECT i, j FROM (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(range(-4, 5)) AS j) WHERE i * i + j * j <= 16)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of CELLS."""
    k, v = F.get_json_object("props", "$.k").cast("int"), F.floor(F.least("value", F.lit(99))).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("scene_id"), k.alias("row"), v.alias("col")).distinct()


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of PATCHES."""
    k, v = F.get_json_object("props", "$.k").cast("int"), F.floor(F.least("value", F.lit(99))).cast("int")
    tenth = lambda c: F.floor(c / 10).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), tenth(k).alias("row"), tenth(v).alias("col")).distinct()


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a 50 x 50 image a user's events make; values by their number."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("scene_id"), (F.get_json_object("props", "$.k").cast("int") % 50).alias("row"), (F.floor("value").cast("int") % 50).alias("col")).agg((F.count("*") % 4).cast("int").alias("v"))


IMAGE = "g AS (SELECT event_type AS scene_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 50 AS row, CAST(floor(value) AS INTEGER) % 50 AS col, CAST(count(*) % 4 AS INTEGER) AS v FROM events GROUP BY ALL)"


def extent(spark: SparkSession) -> DataFrame:
    rows = [(t, 0.0, 10.0, 0.0, 10.0, 0.1, H, W) for t in ("click", "view", "error", "signup", "purchase")]
    return spark.createDataFrame(rows, "scene_id string, x0 double, x1 double, y0 double, y1 double, scale double, h int, w int")


@query("pixel_histogram", f"WITH {IMAGE} SELECT scene_id, v, count(*) AS n FROM g GROUP BY ALL")
def pixel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.pixel_histogram(image(spark, sf_dir))


@query("wall_value", f"WITH {IMAGE}, h AS (SELECT scene_id, v, count(*) AS n FROM g GROUP BY ALL) SELECT scene_id, COALESCE(arg_max(v, (n, -v)) FILTER (WHERE v > 0 AND v < 250), min(v)) AS wall FROM h GROUP BY scene_id")
def wall_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.wall_value(image(spark, sf_dir))


def _components(name: str, near: str, diagonal: bool) -> None:
    sql = f"""WITH RECURSIVE {PATCHES}, e AS (SELECT a.scene_id, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2 FROM c a JOIN c b ON a.scene_id = b.scene_id AND {near}),
reach(scene_id, row, col, r0, c0) AS (SELECT scene_id, row, col, row, col FROM c UNION SELECT x.scene_id, x.row, x.col, e.r2, e.c2 FROM reach x JOIN e ON e.scene_id = x.scene_id AND e.r1 = x.r0 AND e.c1 = x.c0),
f AS (SELECT scene_id, row, col, min((r0, c0)) AS first FROM reach GROUP BY ALL)
SELECT scene_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, dense_rank() OVER (PARTITION BY scene_id ORDER BY first) AS component FROM f"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grid.components(patches(spark, sf_dir), diagonal)


_components("components_by_sides", "abs(a.row - b.row) + abs(a.col - b.col) = 1", False)
_components("components_by_corners", "greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1", True)


@query("inflated_obstacles", f"WITH {CELLS}, {DISK} SELECT DISTINCT scene_id, CAST(row + i AS INTEGER) AS row, CAST(col + j AS INTEGER) AS col FROM c, d")
def inflated_obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.inflated(cells(spark, sf_dir), 0.2, 0.05)


@query("boundary_cells", f"WITH {CELLS} SELECT scene_id, row, col FROM c WHERE (SELECT count(*) FROM c b WHERE b.scene_id = c.scene_id AND abs(b.row - c.row) + abs(b.col - c.col) = 1) < 4")
def boundary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.boundary(cells(spark, sf_dir), ["scene_id"])


@query("mask_centroids", f"WITH {CELLS} SELECT scene_id, CAST(round_even(avg(row), 0) AS INTEGER) AS row, CAST(round_even(avg(col), 0) AS INTEGER) AS col FROM c GROUP BY scene_id")
def mask_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.centroids(cells(spark, sf_dir), ["scene_id"])


@query("mask_summaries", f"WITH {CELLS} SELECT scene_id, count(*) AS area, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, string_agg(row || ':' || col, ',' ORDER BY row, col) AS coords FROM c GROUP BY scene_id")
def mask_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = grid.mask_summary(cells(spark, sf_dir), ["scene_id"])
    return m.withColumn("coords", F.array_join(F.transform("coords", lambda c: F.concat_ws(":", c["row"].cast("string"), c["col"].cast("string"))), ","))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of POINTS, in scene coordinates."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("scene_id"), F.col("event_id").alias("point_id"), (F.col("value") / 10 - 10.05).alias("x"), ((99 - k) / 10 - 10.05).alias("y"))


POINTS = "p AS (SELECT event_type AS scene_id, event_id AS point_id, value / 10 - 10.05 AS x, (99 - CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 10 - 10.05 AS y FROM events)"
HIT = """px < -2 OR px >= 102 OR py < -2 OR py >= 102 OR c.row IS NOT NULL AS collided FROM q LEFT JOIN c ON c.scene_id = q.scene_id AND c.row = greatest(0, least(99, py)) AND c.col = greatest(0, least(99, px))"""
PIXELS = "CAST(round_even((10.0 + x) / 0.1, 0) AS INTEGER) AS px, CAST(round_even((10.0 + y) / 0.1, 0) AS INTEGER) AS py"


@query("point_collisions", f"WITH {CELLS}, {POINTS}, q AS (SELECT *, {PIXELS} FROM p) SELECT point_id, {HIT}")
def point_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.point_collisions(points(spark, sf_dir), cells(spark, sf_dir), extent(spark)).select("point_id", "collided")


@query("path_collisions", f"""WITH {CELLS}, {POINTS}, w AS (SELECT scene_id, point_id, x + (x + 0.5 - x) * (k / 10) AS x, y + (y + 0.3 - y) * (k / 10) AS y FROM p, (SELECT unnest(range(1, 11)) AS k)),
q AS (SELECT *, {PIXELS} FROM w), h AS (SELECT q.scene_id, point_id, {HIT}) SELECT scene_id, point_id AS move_id, bool_or(collided) AS collided FROM h GROUP BY ALL""")  # fmt: skip
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    moves = p.select("scene_id", F.col("point_id").alias("move_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 0.5).alias("x2"), (F.col("y") + 0.3).alias("y2"))
    return grid.path_collisions(moves, cells(spark, sf_dir), extent(spark))


@query("collision_info", f"WITH {IMAGE} SELECT scene_id, count(*) FILTER (WHERE v = 1) AS obstacles, count(*) AS cells, round(count(*) FILTER (WHERE v = 1) / count(*), 6) AS ratio FROM g GROUP BY scene_id")
def collision_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = image(spark, sf_dir).withColumn("blocked", F.col("v") == 1)
    return grid.collision_info(g).withColumn("ratio", F.round("ratio", 6))


@query("rasterised_footprints", """WITH o AS (SELECT vec_id, abs(embedding[1]::DOUBLE) * 8 AS x, abs(embedding[2]::DOUBLE) * 8 AS y, 0.3 + abs(embedding[3]::DOUBLE) AS s FROM embeddings),
p AS (SELECT vec_id, x, y, s, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM o, (SELECT unnest(range(0, 100)) AS i), (SELECT unnest(range(0, 100)) AS j)
  WHERE i BETWEEN greatest(0, floor(y / 0.1)) AND least(99, floor((y + s) / 0.1)) AND j BETWEEN greatest(0, floor(x / 0.1)) AND least(99, floor((x + s) / 0.1))
    AND (j + 0.5) * 0.1 BETWEEN x AND x + s AND (i + 0.5) * 0.1 BETWEEN y AND y + s)
SELECT vec_id AS pos, 99 - i AS row, 99 - j AS col FROM p""")  # fmt: skip
def rasterised_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda k: F.abs(F.col("embedding")[k].cast("double"))
    x, y, s = v(0) * 8, v(1) * 8, v(2) + 0.3
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(corner(x, y), corner(x + s, y), corner(x + s, y + s), corner(x, y + s))
    o = e.select(F.lit("all").alias("scene_id"), F.col("vec_id").alias("pos"), F.col("label").cast("string").alias("label"), ring.alias("ring"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.1).alias("scale"), F.lit(100).alias("h"), F.lit(100).alias("w"))
    return grid.rasterised(o).select("pos", "row", "col")


#: Components by corners of the cells w(scene_id, row, col): f(scene_id, row, col, first), first being a component's least cell.
SPREAD = """lab(scene_id, row, col, first) USING KEY (scene_id, row, col) AS (SELECT scene_id, row, col, row * 1000 + col FROM {w}
UNION SELECT n.scene_id, n.row, n.col, min(x.first) FROM lab x JOIN {w} n ON n.scene_id = x.scene_id AND n.row BETWEEN x.row - 1 AND x.row + 1 AND n.col BETWEEN x.col - 1 AND x.col + 1
  JOIN recurring.lab o ON o.scene_id = n.scene_id AND o.row = n.row AND o.col = n.col WHERE x.first < o.first GROUP BY n.scene_id, n.row, n.col)"""


def _areas(name: str, cells: str) -> str:
    """SQL of the components of cells, as a subquery (scene_id, row, col, first)."""
    return f"(WITH RECURSIVE {name}_w AS ({cells}), {SPREAD.format(w=f'{name}_w')} SELECT * FROM lab)"


@query("semantic_map", f"""WITH {IMAGE}, h AS (SELECT scene_id, v, count(*) AS n FROM g GROUP BY ALL),
wall AS (SELECT scene_id, COALESCE(arg_max(v, (n, -v)) FILTER (WHERE v > 0 AND v < 250), min(v)) AS v FROM h GROUP BY scene_id),
o AS (SELECT vec_id AS pos, ['click', 'view', 'error', 'signup', 'purchase'][label % 5 + 1] AS scene_id, 'Class ' || label AS label, abs(embedding[1]::DOUBLE) * 8 AS x, abs(embedding[2]::DOUBLE) * 8 AS y, 0.3 + abs(embedding[3]::DOUBLE) AS s, abs(embedding[4]::DOUBLE) AS z1 FROM embeddings),
oc AS (SELECT scene_id, pos, label, z1, 49 - i AS row, 49 - j AS col FROM o, (SELECT unnest(range(0, 50)) AS i), (SELECT unnest(range(0, 50)) AS j) WHERE (j + 0.5) * 0.1 BETWEEN x AND x + s AND (i + 0.5) * 0.1 BETWEEN y AND y + s),
om AS (SELECT scene_id, pos, label, z1, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, sum(row) AS sr, sum(col) AS sc FROM oc GROUP BY ALL),
seen AS (SELECT scene_id, label, min(pos) AS first FROM o GROUP BY ALL), cat AS (SELECT scene_id, label, 11 + row_number() OVER (PARTITION BY scene_id ORDER BY first, label) AS category_id FROM seen),
objects AS (SELECT scene_id, category_id, label, '' AS instance_id, replace(lower(label), ' ', '_') || '_' || row_number() OVER (PARTITION BY scene_id, label ORDER BY pos) AS item_id, z1 AS height, 0.0 AS z0, z1, area, r0, r1, c0, c1, sr, sc FROM om JOIN cat USING (scene_id, label)),
wc AS (SELECT scene_id, row, col, first, dense_rank() OVER (PARTITION BY scene_id ORDER BY first) AS k FROM {_areas("wall", "SELECT g.scene_id, 49 - row AS row, col FROM g JOIN wall USING (scene_id) WHERE g.v = wall.v")}),
uc AS (SELECT scene_id, row, col, first, dense_rank() OVER (PARTITION BY scene_id ORDER BY first) AS k FROM {_areas("unable", "SELECT scene_id, 49 - row AS row, col FROM g WHERE v = 0")}),
am AS (SELECT scene_id, 10 AS category_id, 'wall' AS label, k, 3.0 AS height, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, sum(row) AS sr, sum(col) AS sc FROM wc GROUP BY scene_id, k
  UNION ALL SELECT scene_id, -1, 'Unable Area', k, 0.0, count(*), min(row), max(row), min(col), max(col), sum(row), sum(col) FROM uc GROUP BY scene_id, k HAVING count(*) >= 5),
areas AS (SELECT scene_id, category_id, label, replace(lower(label), ' ', '_') || '_' || k AS instance_id, replace(lower(label), ' ', '_') || '_' || row_number() OVER (PARTITION BY scene_id, label ORDER BY k) AS item_id, height, 0.0 AS z0, height AS z1, area, r0, r1, c0, c1, sr, sc FROM am),
m AS (SELECT * FROM objects UNION ALL SELECT * FROM areas)
SELECT scene_id, CAST(category_id AS INTEGER) AS category_id, label, instance_id, item_id, round(CAST(height AS DOUBLE), 6) AS height, round(CAST(z0 AS DOUBLE), 6) AS z0, round(CAST(z1 AS DOUBLE), 6) AS z1, CAST(area AS BIGINT) AS area,
  round(c0 * 0.1::DOUBLE, 6) AS x0, round(r0 * 0.1::DOUBLE, 6) AS y0, round((c1 + 1) * 0.1::DOUBLE, 6) AS x1, round((r1 + 1) * 0.1::DOUBLE, 6) AS y1, round((sr + 0.5 * area) * 0.1::DOUBLE, 3) AS sum_y, round((sc + 0.5 * area) * 0.1::DOUBLE, 3) AS sum_x FROM m""")  # fmt: skip
def semantic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda k: F.abs(F.col("embedding")[k].cast("double"))
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x, y, s = v(0) * 8, v(1) * 8, v(2) + 0.3
    types = F.array(*(F.lit(t) for t in ("click", "view", "error", "signup", "purchase")))
    o = e.select(F.get(types, F.col("label") % 5).alias("scene_id"), F.col("vec_id").alias("pos"), F.concat(F.lit("Class "), F.col("label").cast("string")).alias("label"), F.array(corner(x, y), corner(x + s, y), corner(x + s, y + s), corner(x, y + s)).alias("ring"), F.lit(0.0).alias("z0"), v(3).alias("z1"))
    m = grid.semantic_map(o, image(spark, sf_dir), extent(spark).select("scene_id", "x0", "y0", "scale", F.lit(50).alias("h"), F.lit(50).alias("w")))
    total = lambda k: F.round(F.aggregate("coords", F.lit(0.0), lambda a, c: a + c[k]), 3)
    short = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    box = [F.round(F.col("box")[k], 6).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return m.select("scene_id", F.col("category_id").cast("int").alias("category_id"), "label", "instance_id", "item_id", short("height"), short("z0"), short("z1"), F.col("area").cast("long").alias("area"), *box, total(0).alias("sum_y"), total(1).alias("sum_x"))


@query("planned_paths")
def planned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user, from the top left corner to the cell of each of their events, over what the user's patches leave free but for it."""
    e = table(spark, sf_dir, "events")
    k, v = F.get_json_object("props", "$.k").cast("int"), F.floor(F.least("value", F.lit(99))).cast("int")
    spot = lambda r, c: F.array(F.struct(r.alias("row"), c.alias("col")))
    requests = e.select(F.col("user_id").alias("scene_id"), F.col("event_id").alias("pair_id"), spot(F.lit(0), F.lit(0)).alias("start"), spot(F.floor(k / 10).cast("int"), F.floor(v / 10).cast("int")).alias("goal"))
    size = e.select(F.col("user_id").alias("scene_id"), F.lit(10).alias("h"), F.lit(10).alias("w")).distinct()
    return grid.planned_paths(requests, patches(spark, sf_dir), size).select("scene_id", "pair_id", F.round("cost", 6).alias("cost"), F.size("cells").alias("n_cells"))


@query("connected_items", f"""WITH RECURSIVE {PATCHES}, e AS (SELECT a.scene_id, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2 FROM c a JOIN c b ON a.scene_id = b.scene_id AND greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1),
reach(scene_id, row, col, r0, c0) AS (SELECT scene_id, row, col, row, col FROM c UNION SELECT x.scene_id, x.row, x.col, e.r2, e.c2 FROM reach x JOIN e ON e.scene_id = x.scene_id AND e.r1 = x.r0 AND e.c1 = x.c0),
f AS (SELECT scene_id, row, col, min((r0, c0)) AS first FROM reach GROUP BY ALL), g AS (SELECT *, dense_rank() OVER (PARTITION BY scene_id ORDER BY first) AS component FROM f)
SELECT DISTINCT user_id AS scene_id, event_type AS item_id, component FROM events JOIN g ON scene_id = user_id AND row = CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AND col = CAST(floor(least(value, 99)) AS INTEGER) // 10""")  # fmt: skip
def connected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.get_json_object("props", "$.k").cast("int"), F.floor(F.least("value", F.lit(99))).cast("int")
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), F.col("event_type").alias("item_id"), F.floor(k / 10).alias("row"), F.floor(v / 10).alias("col"))
    return grid.connected_items(items, grid.components(patches(spark, sf_dir), True))


@query("safe_moves", f"""WITH {CELLS}, {POINTS}, m AS (SELECT scene_id, point_id AS move_id, abs(x) AS x, abs(y) AS y, 0.1::DOUBLE / sqrt(0.02::DOUBLE) AS u FROM p),
s AS (SELECT m.*, i, x + u * 0.01::DOUBLE * i AS a, y + u * 0.01::DOUBLE * i AS b FROM m, (SELECT unnest(range(1, 15)) AS i)),
k AS (SELECT s.scene_id, move_id, any_value(x) AS x, any_value(y) AS y, any_value(u) AS u, COALESCE(min(i) FILTER (WHERE c.row IS NOT NULL) - 1, 14) AS k
  FROM s LEFT JOIN c ON c.scene_id = s.scene_id AND c.row = CAST(round_even(b / 0.1::DOUBLE, 0) AS INTEGER) AND c.col = CAST(round_even(a / 0.1::DOUBLE, 0) AS INTEGER) GROUP BY s.scene_id, move_id),
t AS (SELECT scene_id, move_id, j, dir, x + CASE dir WHEN 0 THEN -u WHEN 1 THEN u WHEN 2 THEN u ELSE -u END * 0.005::DOUBLE * j AS a, y + CASE dir WHEN 0 THEN u WHEN 1 THEN -u WHEN 2 THEN u ELSE -u END * 0.005::DOUBLE * j AS b
  FROM k, (SELECT unnest(range(1, 11)) AS j), (SELECT unnest(range(0, 4)) AS dir) WHERE k = 0),
f AS (SELECT t.scene_id, move_id, arg_min(a, j * 4 + dir) FILTER (WHERE c.row IS NULL) AS a, arg_min(b, j * 4 + dir) FILTER (WHERE c.row IS NULL) AS b
  FROM t LEFT JOIN c ON c.scene_id = t.scene_id AND c.row = CAST(round_even(b / 0.1::DOUBLE, 0) AS INTEGER) AND c.col = CAST(round_even(a / 0.1::DOUBLE, 0) AS INTEGER) GROUP BY t.scene_id, move_id),
r AS (SELECT k.scene_id, k.move_id, k.x AS ox, k.y AS oy, CASE WHEN k > 0 THEN x + u * 0.01::DOUBLE * k ELSE COALESCE(a, x) END AS x, CASE WHEN k > 0 THEN y + u * 0.01::DOUBLE * k ELSE COALESCE(b, y) END AS y FROM k LEFT JOIN f USING (scene_id, move_id))
SELECT scene_id, move_id, round(x, 6) AS x, round(y, 6) AS y, round(sqrt((x - ox) ** 2 + (y - oy) ** 2), 6) AS moved FROM r""")  # fmt: skip
def safe_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    moves = p.select("scene_id", F.col("point_id").alias("move_id"), F.abs("x").alias("x"), F.abs("y").alias("y"), F.lit(0.1).alias("dx"), F.lit(0.1).alias("dy"))
    found = grid.safe_moves(moves, cells(spark, sf_dir), 0.1)
    return found.select("scene_id", "move_id", *(F.round(c, 6).alias(c) for c in ("x", "y", "moved")))
