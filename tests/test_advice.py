"""Queries and operators do the whole job."""

import fnmatch
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import scratch, stages
from waymark.operators import actions, grid, joins, selection, stats
from waymark.plans import ORACLES, QUERIES
from waymark.sources import readers


def test_grid_queries_use_every_event(spark, tmp_path):
    """All ids are 2 or 3 modulo 4; a wall of events at row 50 and points of others."""
    wall = [(4 * k + 2, 1, "click", k + 0.5, '{"k": 50}') for k in range(100)]
    rows = [*wall, (403, 2, "click", 1.5, '{"k": 51}'), (407, 2, "click", 1.5, '{"k": 10}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    moves = {r.move_id: r.collided for r in QUERIES["path_collisions"](spark, str(tmp_path)).collect()}
    assert len(moves) == len(rows) and moves[403] and not moves[407]
    assert QUERIES["safe_moves"](spark, str(tmp_path)).count() == len(rows)
    paths = {(r.scene_id, r.pair_id): r.cost for r in QUERIES["planned_paths"](spark, str(tmp_path)).collect()}
    assert len(paths) == len(rows) and paths[1, 2] is not None
    assert QUERIES["components_by_corners"](spark, str(tmp_path)).count() == 12


def test_written_maps_keep_masks(spark, tmp_path):
    """Map documents come back whole, and give the bounds of the map."""
    box = lambda z1: [{"x": x, "y": y, "z": z} for z in (0, z1) for x, y in ((0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.0, 0.2))]
    raw = tmp_path / "raw" / "0001_a"
    raw.mkdir(parents=True)
    (raw / "labels.json").write_text(json.dumps([{"label": "rug"}, {"label": "Lamp", "ins_id": "i7", "bounding_box": box(1.5)}, {"label": "chair", "bounding_box": box(1)}]))
    (raw / "occupancy.json").write_text(json.dumps({"scale": 0.1, "min": [1, 2, 0]}))
    (raw / "occupancy.pgm").write_bytes(b"P5 5 3 255\n" + bytes([0] * 5 + [255] * 5 + [100] * 5))
    labels = raw / "labels.json"
    labels.write_text(labels.read_text().replace('"x": 0.', '"x": 1.').replace('"y": 0.', '"y": 2.'))
    stages.semantic_map(spark, str(labels), f"{raw}/occupancy.pgm", f"{raw}/occupancy.json", f"{tmp_path}/maps")
    m = readers.semantic_map(spark, f"{tmp_path}/maps/*")
    rows = m.orderBy("pos").collect()
    assert {r.scene_id for r in rows} == {"0001_a"}
    assert [(r.item_id, r.instance_id, r.category_id, r.height_m, r.min_z_m, r.max_z_m) for r in rows] == [
        ("chair_1", "", 3, "1.00", "0.00", "1.00"), ("lamp_1", "i7", 13, "1.50", "0.00", "1.50"),
        ("wall_1", "wall_1", 10, "3.00", "0.00", "3.00"), ("unable_area_1", "unable_area_1", -1, "0.00", "0.00", "0.00"),
    ]
    assert all(len(r.mask_coords_m) == r.area for r in rows)
    assert rows[0].mask_coords_m == [["2.15", "1.35"], ["2.15", "1.45"], ["2.25", "1.35"], ["2.25", "1.45"]]
    assert rows[0].bbox_m == ["1.30", "2.10", "1.50", "2.30"] and rows[0].bbox_xywh_m == ["1.30", "2.10", "0.20", "0.20"]
    b = stats.map_bounds(m.withColumnRenamed("mask_coords_m", "coords"), ["scene_id"]).first()
    assert (b.x0, b.x1, b.y0, b.y1) == (1.05, 1.45, 2.05, 2.25)


def test_parts_of_many_rows_with_a_payload(spark):
    """Ranges are sampled above some size; places still run through without gaps."""
    n = 1_200_000
    rows = spark.range(n).repartition(9).withColumn("payload", F.sha2(F.col("id").cast("string"), 256))
    placed = selection.parts_of(rows, 10_000, [F.xxhash64("id"), F.col("id")]).select("place", "part")
    assert tuple(placed.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()) == (n, 0, n - 1)
    assert {r["count"] for r in placed.groupBy("part").count().collect()} == {10_000}


def test_files_are_found_by_the_first_pattern(spark):
    names = ["839", "12", "8391", "a", "0042_x", "none"]
    files = ["839.usd", "839.usda", "x12y.usd", "8391.usda", "12.usda.bak", "2D_Semantic_Map_1_839_Complete.json", "2D_Semantic_Map_839_Complete.json", "q_12_Complete.json", "zz8391zz.json", "2D_Semantic_Map_7_8391_Complete.json", "a.json", "2D_Semantic_Map_0042_x_Complete.json", "2D_Semantic_Map_3_0042_x_Complete.json", "_a_Complete.json", ".usda"]
    for patterns in (joins.SCENE_FILES, joins.MAP_FILES):
        found = joins.ranked_match(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(f,) for f in files], "file string"), "n", patterns)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = {}
        for n in names:
            fits = [(k, f) for k, p in enumerate(patterns) for f in files if fnmatch.fnmatchcase(f, p.replace("{}", n))]
            if fits:
                want[n] = min(fits)
        assert {r.n: (r["rank"], r.file) for r in found.collect()} == want


def test_waypoints_near_and_far(spark):
    rng = random.Random(1)
    w = [(k, i, rng.uniform(0, 100) if k else rng.choice([0.0, 1e6]), rng.uniform(0, 100)) for k in range(3) for i in range([5, 200, 40][k])]
    p = [(k, i, rng.uniform(-500, 500), rng.uniform(-50, 500)) for k in range(4) for i in range(80)] + [(1, 900, w[7][2], w[7][3]), (1, 901, None, 0.0)]
    got = joins.nearest_waypoint(spark.createDataFrame(p, "k int, position_id int, x double, y double"), spark.createDataFrame(w, "k int, seq int, x double, y double"), "k").collect()
    want = {(k, i): min((math.hypot(x - a, y - b), q) for kk, q, a, b in w if kk == k)[1] for k, i, x, y in p if k < 3 and x is not None}
    assert {(r.k, r.position_id): r.nearest for r in got} == want


def test_components_of_many_cells():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 60, (1800, 2)), axis=0)
    rng.shuffle(cells)
    for offsets in (grid.FOUR, grid.EIGHT):
        found, n, left = {}, 0, {tuple(c) for c in cells.tolist()}
        for c in sorted(left):
            if c in left:
                n += 1
                todo = [c]
                left.discard(c)
                while todo:
                    r, k = todo.pop()
                    found[r, k] = n
                    for a, b in offsets:
                        if (r + a, k + b) in left:
                            left.discard((r + a, k + b))
                            todo.append((r + a, k + b))
        assert grid.labelled(cells[:, 0], cells[:, 1], offsets).tolist() == [found[tuple(c)] for c in cells.tolist()]


def plain_moves(moves, blocked, scale):
    """Step by step, as an agent would walk."""
    out = {}
    for i, x, y, dx, dy in moves:
        taken = lambda a, b: (round(b / scale), round(a / scale)) in blocked
        d = math.hypot(dx, dy)
        px, py = x, y
        if d > 0:
            ux, uy = dx / d, dy / d
            n, k = int(min(d, 0.2) / 0.01 + 1e-9), 0
            while k < n and not taken(x + ux * 0.01 * (k + 1), y + uy * 0.01 * (k + 1)):
                k += 1
            px, py = x + ux * 0.01 * k, y + uy * 0.01 * k
            if n and not k:
                tries = [(x + a * 0.005 * j, y + b * 0.005 * j) for j in range(1, 11) for a, b in ((-uy, ux), (uy, -ux), (ux, uy), (-ux, -uy))]
                px, py = next((t for t in tries if not taken(*t)), (x, y))
        out[i] = (pytest.approx(px), pytest.approx(py), pytest.approx(math.hypot(px - x, py - y), abs=1e-12))
    return out


def test_moves_stop_before_obstacles(spark, monkeypatch):
    monkeypatch.setattr(grid, "MOVES", 40)
    rng = random.Random(4)
    blocked = {(rng.randrange(-3, 20), rng.randrange(-3, 20)) for _ in range(150)}
    moves = [(i, rng.uniform(-0.3, 1.7), rng.uniform(-0.3, 1.7), rng.choice([0.0, rng.uniform(-0.4, 0.4)]), rng.choice([0.0, rng.uniform(-0.4, 0.4)])) for i in range(300)]
    rows = [("s", *m) for m in moves] + [("t", 900, 0.0, 0.0, 0.1, 0.0), ("s", 901, None, 0.0, 0.1, 0.0)]
    b = spark.createDataFrame([("s", r, c) for r, c in blocked], "scene_id string, row int, col int")
    got = {r.move_id: (r.x, r.y, r.moved) for r in grid.safe_moves(spark.createDataFrame(rows, "scene_id string, move_id int, x double, y double, dx double, dy double"), b, 0.1).collect()}
    assert got.pop(901) == (None, None, None) and got.pop(900) == (pytest.approx(0.1), 0.0, pytest.approx(0.1))
    assert got == plain_moves(moves, blocked, 0.1)


def test_items_are_connected_by_their_component(spark):
    parts = spark.createDataFrame([("s", 0, 0, 1), ("s", 0, 1, 1), ("s", 5, 5, 2)], "scene_id string, row int, col int, component int")
    items = spark.createDataFrame([("s", "a", 0, 0), ("s", "b", 0, 1), ("s", "c", 5, 5), ("s", "d", 9, 9)], "scene_id string, item_id string, row int, col int")
    members = grid.connected_items(items, parts)
    pairs = spark.createDataFrame([("s", x, y) for x in "abcd" for y in "abcd" if x != y], "scene_id string, start string, end string")
    assert {(r.start, r.end) for r in grid.connected(pairs, members).collect()} == {("a", "b"), ("b", "a")}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())


def test_actions_of_turns_that_the_last_bit_decides(spark, tmp_path):
    """Turns by exactly half a turn and by exactly 45 degrees go as in SQL, on a grid of positions that is full of them."""
    rng = random.Random(8)
    rows = [(i, i % 300, "click", 5.0 * rng.randrange(13), f'{{"k": {5 * rng.randrange(13)}}}', i) for i in range(6000)]
    t = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, at long")
    t.withColumn("ts", F.timestamp_seconds("at")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("action_sequences", "action_breakdown", "interpolated_poses"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()), name


def test_actions_of_distances_that_the_last_bit_decides(spark, tmp_path):
    """Legs of one to four whole moves in any direction, picked where a product and the C library's power differ at the border, go as in SQL."""
    rng = random.Random(9)
    rows, near = [], 0
    while near < 8:
        turn, far = rng.uniform(0, 2 * math.pi), 25.0 * rng.randrange(1, 5)
        x, y = 500 + far * math.cos(turn), 300 + far * math.sin(turn)
        dx, dy = x / 100 - 5, y / 100 - 3
        if math.sqrt(dx * dx + dy * dy) // 0.25 != math.sqrt(math.pow(dx, 2) + math.pow(dy, 2)) // 0.25:
            near += 1
            # a later leg of 12.4 moves tells which one got the move
            rows += [(4 * near + i, near, "click", float(a), f'{{"k": {b!r}}}', i) for i, (a, b) in enumerate([(500, 300), (x, y), (x, y + 10), (x + 300, y + 10)])]
    t = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, at long")
    t.withColumn("ts", F.timestamp_seconds("at")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("action_sequences", "action_breakdown", "interpolated_poses"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()), name


def test_actions_of_unknown_places_and_users(spark, tmp_path):
    """After an unknown place the rest last known decides on the last move, and events without a user only stop, as in SQL."""
    rows = [(i, u, "click", None if u == 2 and i == 3 else 30.0 * i, '{"k": 5}' if u != 1 or i != 2 else "{}", i) for u in (1, 2, 3, None) for i in range(5)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    rows += [(100 + i, 4, "click", x, '{"k": 5}', i) for i, x in enumerate([0.0, 20.0, None])]
    t = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, at long")
    t.withColumn("ts", F.timestamp_seconds("at")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("action_sequences", "action_breakdown"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())), name


def test_action_breakdown_of_whole_paths(spark, tmp_path):
    """A turn after 200 moves and the moves after it count, and long random paths go as in SQL."""
    there = [(1, 50.0 * i, 0.0) for i in range(101)] + [(1, 5000.0, 50.0 * i) for i in range(1, 51)] + [(2, 7.0, 7.0)]
    rng = random.Random(10)
    wild = [(u, rng.choice([rng.uniform(0, 300), 5.0 * rng.randrange(60)]), rng.uniform(0, 300)) for u in range(3, 9) for _ in range(50 * u)]
    for name, places in (("there", there), ("wild", wild)):
        rows = [(i, u, "click", x, f'{{"k": {y!r}}}', i) for i, (u, x, y) in enumerate(places)]
        t = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, at long")
        t.withColumn("ts", F.timestamp_seconds("at")).drop("at").write.parquet(f"{tmp_path}/{name}/events.parquet")
        df = QUERIES["action_breakdown"](spark, f"{tmp_path}/{name}")
        got = df.collect()
        if name == "there":
            assert {r.action: r.n for r in got} == {"TURN_LEFT": 4, "MOVE_FORWARD": 300, "TURN_RIGHT": 4, "STOP": 2}
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{name}/events.parquet/*.parquet'")
        assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['action_breakdown']})").fetchall()), name


@pytest.mark.parametrize("name", sorted(actions.PRESETS))
def test_counts_of_a_plain_walk(spark, name):
    """Each path's counts, by a plain loop without an end at the most actions; places and headings that are not known are among them."""
    rng, how = random.Random(name), actions.preset(name)
    paths = {i: [(rng.uniform(0, 3), rng.uniform(0, 3), 0.5, rng.uniform(-3.1, 3.1)) for _ in range(n)] for i, n in enumerate([1, 2, 3, 60, 150, 400])}
    paths[6] = [*paths[3][:30], (None, 1.0, 0.5, None), *paths[3][30:]]
    rows = [(i, s, *p) for i, path in paths.items() for s, p in enumerate(path)]
    points = actions.c_lengths(spark.createDataFrame(rows, "path_id int, seq int, x double, y double, z double, yaw double"))
    got = {r.path_id: r.counts for r in actions.counted(points, how).collect()}
    for i, path in paths.items():
        want, rest, known = {"STOP": 1}, 0.0, 0.0
        for a, b in zip(path, path[1:]):
            turn = None if a[3] is None or b[3] is None else math.remainder(b[3] - a[3], 2 * math.pi)
            if turn is not None and abs(turn) > math.radians(15):
                side = "TURN_LEFT" if turn > 0 else "TURN_RIGHT"
                want[side] = want.get(side, 0) + min(4, max(1, int(abs(turn) / math.radians(how.turn))))
            rest = None if rest is None or None in a[:3] + b[:3] else rest + math.sqrt(sum(math.pow(q - p, 2) for p, q in zip(a[:3], b[:3])))
            moves = 5 if rest is None else min(5, int(rest / how.move))
            for _ in range(moves if rest is not None else 0):
                rest -= how.move
            known = known if rest is None else rest
            if moves:
                want["MOVE_FORWARD"] = want.get("MOVE_FORWARD", 0) + moves
        if known > how.move * 0.5:
            want["MOVE_FORWARD"] = want.get("MOVE_FORWARD", 0) + 1
        assert got[i] == want, i
