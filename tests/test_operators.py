"""Operators on small literals with answers worked out by hand, and folds against plain loops."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry, text
from waymark.operators import actions, adapters, episodes, grid, joins, measures, selection, stats
from waymark.sources import readers, writers
from waymark.streaming import online


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def steps(spark, rows, collided=None):
    data = [("e", i, float(i), float(x), float(y), float(z), bool(collided and collided[i])) for i, (x, y, z) in enumerate(rows)]
    return spark.createDataFrame(data, "episode_id string, seq int, t double, x double, y double, z double, collided boolean")


def goals(spark, x, y, radius):
    return spark.createDataFrame([("e", float(x), float(y), 0.0, float(radius))], "episode_id string, gx double, gy double, gz double, radius double")


def test_path_length_and_spl(spark):
    s = steps(spark, [(0, 0, 0), (3, 4, 0), (3, 4, 0), (3, 0, 0)])
    r = measures.evaluated(s, goals(spark, 3, 4, 10)).first()
    assert r.path_length == 9
    assert r.spl == pytest.approx(5 / 9)


@pytest.mark.parametrize(("path", "expected"), [([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)], 1.0), ([(0, 0, 0), (1, 0, 0), (1, 1, 0)], 1 / (1 + 10 * math.sqrt(2))), ([(0, 0, 0)], 1.0)])
def test_smoothness(spark, path, expected):
    assert measures.evaluated(steps(spark, path)).first().path_smoothness == pytest.approx(expected)


def test_collision_penalty(spark):
    s = steps(spark, [(0, 0, 0)] * 8, [0, 1, 0, 0, 0, 1, 1, 0])
    r = measures.evaluated(s).first()
    assert (r.integrated_collision_penalty, r.collision_count) == (0.75, 3)


def test_success_thresholds(spark):
    s = steps(spark, [(1, 0, 0), (2, 0, 0), (2.1, 0, 0)])
    r = measures.evaluated(s, goals(spark, 0, 0, 0.5)).first()
    assert (r.success, r.oracle_success) == (0, 1)
    assert r.continuous_success_ratio == pytest.approx(2 / 3)


def test_cells(spark):
    s = steps(spark, [(-0.49, 0, 0), (0.49, 0, 0), (0.5, 0, 0), (-0.5, 0, 0)])
    assert measures.evaluated(s).first().explored_areas == 3


def test_cadence_is_doubled_but_for_the_last(spark):
    seqs = [r.x for r in measures.expand_cadence(steps(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])).orderBy("seq").collect()]
    assert seqs == [0, 0, 1, 1, 2]


def test_blocked_moves(spark):
    rows = [(0.1, 0.01), (0.1, 0.02), (0.0, 0.0), (0.1, 0.05), (0.1, 0.09), (0.04, 0.0)]
    df = spark.createDataFrame([("e", i, a, b) for i, (a, b) in enumerate(rows)], "episode_id string, seq int, intended double, actual double")
    assert [r.blocked for r in measures.consecutive_collisions(df).orderBy("seq").collect()] == [1, 2, 2, 2, 0, 0]


@pytest.mark.parametrize(("lengths", "expected"), [([5, 1, 4, 2, 9, 7], (4, 7)), ([8, 3], (3, 8))])
def test_terciles(spark, lengths, expected):
    df = spark.createDataFrame([("s", n) for n in lengths], "s string, n int")
    assert stats.tercile_thresholds(df, "n", ["s"]).select("short", "long").first() == expected
    assert stats.global_terciles(df, "n").first() == expected


def test_terciles_of_nothing(spark):
    assert stats.global_terciles(spark.createDataFrame([], "n int"), "n").first() == (10, 50)


def test_stats_of_one(spark):
    r = stats.length_stats(spark.createDataFrame([("s", 7)], "s string, n int"), "n", ["s"]).first()
    assert (r.median_length, r.std_length) == (7, 0)


def test_quotas(spark):
    df = spark.createDataFrame([("s", i, 4) for i in range(4)], "s string, i int, n int")
    assert selection.greedy_quota(df, "n", 10, ["s"], ["i"]).count() == 3
    nine = spark.createDataFrame([("s", i, 9) for i in range(3)], "s string, i int, n int")
    assert [r.taken for r in selection.capped_quota(nine, "n", 7, ["s"], ["i"]).orderBy("i").collect()] == [4, 3]


def test_scene_quotas_count_what_was_taken(spark):
    rng = random.Random(1)
    for _ in range(10):
        target = rng.randint(5, 60)
        scenes = [(f"s{k}", [rng.randint(1, 9) for _ in range(rng.randint(1, 6))]) for k in range(rng.randint(1, 6))]
        used, expected = 0, []
        for name, counts in scenes:
            if used >= target:
                break
            quota, own = min(target - used, target // len(scenes)), 0
            for c in counts:
                if own >= quota:
                    break
                own += c
            expected.append((name, quota))
            used += own
        df = spark.createDataFrame([(scenes,)], "s array<struct<scene_id:string,counts:array<bigint>>>")
        got = df.select(selection.scene_targets(F.col("s"), target).alias("q")).first().q
        assert [(x.scene_id, x.quota) for x in got] == expected


def test_splits_are_disjoint_and_whole(spark):
    scenes = spark.createDataFrame([(i, 10 + i % 7, "home" if i % 3 else "non_home") for i in range(60)], "scene_id long, pairs long, scene_type string")
    t = spark.createDataFrame([(i, 100 * i + k, 2 + (i + k) % 4) for i in range(60) for k in range(6)], "scene_id long, trajectory_id long, instruction_count long")
    found = {k: v.collect() for k, v in selection.splits(scenes, t, 8, 6, 60, 5).items()}
    unseen, held = ({r.scene_id for r in found[k]} for k in ("scene_unseen", "val"))
    assert (len(unseen), len(held)) == (6, 8) and not unseen & held
    tested = {(r.scene_id, r.trajectory_id) for r in found["trajectory_unseen"]}
    train = {(r.scene_id, r.trajectory_id): r.instruction_count for r in found["train"]}
    assert not tested & set(train) and tested
    assert not {s for s, _ in tested} & {r.scene_id for r in found["instruction_unseen"]}
    total = sum(train.values()) + sum(r.instruction_count for r in found["trajectory_unseen"]) + sum(r.taken for r in found["instruction_unseen"])
    assert total == sum(2 + (i + k) % 4 for i in range(60) for k in range(6) if i not in unseen | held)


def test_merge_renumbers_by_part(spark):
    df = spark.createDataFrame([("s", p, i) for p, n in ((10, 1), (None, 2), (2, 3)) for i in range(n)], "scene_id string, part int, pos int")
    rows = selection.merged_parts(df).orderBy(F.col("trajectory_id").cast("int")).collect()
    assert [(r.part, r.trajectory_id) for r in rows] == [(None, "0"), (None, "1"), (2, "2"), (2, "3"), (2, "4"), (10, "5")]


def test_training_windows(spark):
    df = spark.createDataFrame([("v", ["a", "b", "c"], ["F", "L", "S", "S"])], "video_id string, frames array<string>, actions array<string>")
    assert [r.frames for r in actions.training_windows(df).orderBy("step").collect()] == [["a"], ["a", "b"], ["a", "b", "c"]]


def test_pixels_round_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.175,), (0.225,)], "v double")
    assert [r.p for r in df.select(geometry.to_pixel(F.col("v"), 0.0, 0.05).alias("p")).collect()] == [2, 3, 4]


def test_mirror_and_back(spark):
    v = geometry.mirrored(F.lit(3.0), F.lit(0.0), F.lit(10.0))
    assert value(spark, v) == -7 and value(spark, geometry.unmirrored(v, F.lit(0.0), F.lit(10.0))) == 3


@pytest.mark.parametrize("a", [-10.0, -math.pi, -1.0, 0.0, math.pi, 3.5, 9.0, 100.0])
def test_normalised_angles(spark, a):
    b = a
    while b > math.pi:
        b -= 2 * math.pi
    while b < -math.pi:
        b += 2 * math.pi
    assert value(spark, geometry.normalised(F.lit(a))) == pytest.approx(b)


def plain_slerp(a, b, t):
    unit = lambda q: q / n if (n := np.sqrt((q * q).sum())) > 0 else q
    a, b = unit(np.array(a, float)), unit(np.array(b, float))
    dot = float(a @ b)
    if dot < 0:
        b, dot = -b, -dot
    if dot > 0.9995:
        return unit(a + t * (b - a))
    theta = math.acos(min(dot, 1.0))
    return (math.sin((1 - t) * theta) * a + math.sin(t * theta) * b) / math.sin(theta)


def plain_poses(points, n, how):
    """One pose for each action, leg by leg."""
    flat = [list(p) for p in points]
    if len(flat) < 2 or n == len(flat):
        return flat[:n] + flat[-1:] * max(0, n - len(flat)) if flat else []
    out = []
    for a, b in zip(flat, flat[1:]):
        out.append(a)
        turn = b[3] - a[3]
        while turn > math.pi:
            turn -= 2 * math.pi
        while turn < -math.pi:
            turn += 2 * math.pi
        turns = min(4, max(1, int(abs(turn) / math.radians(how.turn)))) if abs(turn) > math.radians(15) else 0
        parts = turns + min(5, int(math.dist(a[:3], b[:3]) / how.move))
        for j in range(1, parts):
            s, c = plain_slerp([math.sin(a[3] / 2), math.cos(a[3] / 2)], [math.sin(b[3] / 2), math.cos(b[3] / 2)], j / parts)
            out.append([x + (y - x) * j / parts for x, y in zip(a[:3], b[:3])] + [2 * math.atan2(s, c)])
    return out[: n - 1] + [flat[-1]] * (n - min(len(out), n - 1))


def test_slerp(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        p, q, t = rng.normal(size=4), rng.normal(size=4), float(rng.random())
        got = value(spark, geometry.slerp(F.array(*map(F.lit, map(float, p))), F.array(*map(F.lit, map(float, q))), F.lit(t)))
        assert got == pytest.approx(plain_slerp(p, q, t).tolist())


def walk(points, how):
    """Actions of a path, by a plain loop over the rules."""
    if len(points) < 2:
        return ["STOP"]
    out, rest = [], 0.0
    for a, b in zip(points, points[1:]):
        turn = b[3] - a[3]
        while turn > math.pi:
            turn -= 2 * math.pi
        while turn < -math.pi:
            turn += 2 * math.pi
        if abs(turn) > math.radians(15):
            out += ["TURN_LEFT" if turn > 0 else "TURN_RIGHT"] * min(4, max(1, int(abs(turn) / math.radians(how.turn))))
        rest += math.sqrt(sum((y - x) ** 2 for x, y in zip(a[:3], b[:3])))
        for _ in range(min(5, int(rest / how.move))):
            out.append("MOVE_FORWARD")
            rest -= how.move
        if len(out) >= min(50, how.most * 2):
            break
    return out + ["MOVE_FORWARD"] * (rest > how.move * 0.5) + ["STOP"]


@pytest.mark.parametrize("name", sorted(actions.PRESETS))
def test_actions_match_a_plain_walk(spark, name):
    rng, how = random.Random(name), actions.preset(name)
    paths = [(i, [(rng.uniform(0, 3), rng.uniform(0, 3), 0.5, rng.uniform(-3.1, 3.1)) for _ in range(rng.randint(0, 40))]) for i in range(40)]
    df = spark.createDataFrame(paths, "path_id int, points array<struct<x:double,y:double,z:double,yaw:double>>").withColumn("actions", actions.discretised(F.col("points"), how))
    rows = {r.path_id: r for r in actions.interpolated(df, how).collect()}
    for i, p in paths:
        assert rows[i].actions == walk(p, how)
        if p:
            assert len(rows[i].poses) == len(rows[i].actions)
            assert rows[i].poses[-1] == pytest.approx(list(p[-1] if len(p) > 1 else p[0]))
        want = plain_poses(p, len(rows[i].actions), how)
        assert [x for pose in rows[i].poses for x in pose] == pytest.approx([x for pose in want for x in pose], abs=1e-9)


def test_move_cap(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0, 0.0, 0.0), (2.0, 0.0, 0.0, math.radians(20))])], "path_id int, points array<struct<x:double,y:double,z:double,yaw:double>>")
    got = df.select(actions.discretised(F.col("points"), actions.preset("vlnce")).alias("a")).first().a
    assert got == ["TURN_LEFT"] + ["MOVE_FORWARD"] * 6 + ["STOP"]


def test_uniform_sample_matches_places(spark):
    for n in (1, 2, 14, 15, 16, 80, 131):
        df = spark.createDataFrame([("p", i) for i in range(n)], "path_id string, seq int")
        k = min(max(15, n // 5), n)
        places = list(range(n)) if k >= n else [int(i * (n - 1) / (k - 1)) for i in range(k)]
        assert [r.seq for r in actions.uniform_sample(df).orderBy("seq").collect()] == sorted(set(places))


PLUS = [(1, 1), (0, 1), (2, 1), (1, 0), (1, 2), (3, 2)]


def test_components(spark):
    df = spark.createDataFrame([("s", *c) for c in PLUS], "scene_id string, row int, col int")
    count = lambda d: grid.components(df, d).agg(F.count_distinct("component")).first()[0]
    assert (count(False), count(True)) == (2, 1)


def test_inflation(spark):
    one = spark.createDataFrame([("s", 10, 10)], "scene_id string, row int, col int")
    assert grid.inflated(one, 0.2, 0.05).count() == 49


def test_class_ids(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["door", "lamp", "rug", "lamp"])], "i int, label string")
    names = ["door", "window", "chair", "table", "sofa", "bed", "wardrobe", "plant", "floor", "wall", "ceiling"]
    assert {r.label: r.class_id for r in stats.class_ids(df, "label", "i", names).collect()} == {"door": 1, "lamp": 12, "rug": 13}


def test_search_is_shortest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        free = rng.random((9, 9)) > 0.3
        free[0, 0] = free[8, 8] = True
        dist = {(0, 0): 0.0}
        for _ in range(81):  # relaxation of all edges
            for (r, c), d in list(dist.items()):
                for a, b in grid.EIGHT:
                    n = (r + a, c + b)
                    if 0 <= n[0] < 9 and 0 <= n[1] < 9 and free[n] and d + math.hypot(a, b) < dist.get(n, math.inf) - 1e-12:
                        dist[n] = d + math.hypot(a, b)
        cost, path = grid.search(free, (0, 0), (8, 8))
        assert cost == pytest.approx(dist.get((8, 8), math.inf))
        assert (path and path[0] == (0, 0) and path[-1] == (8, 8)) or math.isinf(cost)


def test_polygon_covers_its_border(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))))
    inside = [value(spark, geometry.covered(F.lit(x), F.lit(y), ring)) for x, y in ((1.0, 1.0), (0.0, 1.0), (2.0, 2.0), (2.1, 1.0), (-1.0, 0.0))]
    assert inside == [True, True, True, False, False]


def test_semantic_map_numbers_and_flips(spark):
    square = [(0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.0, 0.2)]
    objects = spark.createDataFrame([("s", 0, "Big Lamp", square, 0.0, 1.5), ("s", 1, "Big Lamp", [(9.0, 9.0)] * 4, 0.0, 1.0), ("s", 2, "Big Lamp", square, 0.0, 1.0)], "scene_id string, pos int, label string, ring array<struct<x:double,y:double>>, z0 double, z1 double")
    pixels = [("s", r, c, 0 if r == 0 else (100 if r == 3 else 255)) for r in range(4) for c in range(5)]
    image = spark.createDataFrame(pixels, "scene_id string, row int, col int, v int")
    extent = spark.createDataFrame([("s", 0.0, 0.0, 0.1, 4, 5)], "scene_id string, x0 double, y0 double, scale double, h int, w int")
    rows = {r.item_id: r for r in grid.semantic_map(objects, image, extent).collect()}
    assert set(rows) == {"big_lamp_1", "big_lamp_2", "wall_1", "unable_area_1"}
    assert rows["big_lamp_1"].area == 4 and rows["big_lamp_1"].box == pytest.approx([0.3, 0.2, 0.5, 0.4])
    assert rows["wall_1"].box == pytest.approx([0.0, 0.0, 0.5, 0.1]) and rows["unable_area_1"].box == pytest.approx([0.0, 0.3, 0.5, 0.4])


@pytest.mark.parametrize(
    ("answer", "expected"),
    [('{"a": 1}', '{"a":1}'), ('x ```json\n[1, 2]\n``` y', "[1,2]"), ('two: [{"a":1}, {"b":2}]!', '[{"a":1},{"b":2}]'), ("none", None), ("", None), (None, None), ('{"a": } ```\n{"b":1}\n```', '{"b":1}')],
)
def test_robust_json(spark, answer, expected):
    got = value(spark, F.to_json(text.robust_json(F.lit(answer).cast("string"))))
    assert (json.loads(got) if got else None) == (json.loads(expected) if expected else None)


@pytest.mark.parametrize(
    ("said", "vx", "rate", "stop"),
    [("move forward 0.35 meter", 0.35, 0, False), ("move forward 2 m", 0.5, 0, False), ("go straight", 0.3, 0, False), ("turn left 45 degree", 0, math.radians(45), False), ("turn right", 0, -math.radians(30), False), ("task done", 0, 0, True), ("go back", -0.2, 0, False), ("", 0, 0, False), (None, 0, 0, False)],
)
def test_text_commands(spark, said, vx, rate, stop):
    r = value(spark, text.text_command(F.lit(said).cast("string")))
    assert (r.vx, r.yaw_rate, r.stop) == (pytest.approx(vx), pytest.approx(rate), stop)


def test_two_decimals(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.675,), (-0.5,)], "v double")
    assert [r.t for r in df.select(text.two_decimals(F.col("v")).alias("t")).collect()] == [f"{x:.2f}" for x in (0.125, 1.005, 2.675, -0.5)]


def test_object_success_methods(spark):
    box = [0.0, 0.0, 1.0, 1.0]
    objects = spark.createDataFrame([("s", "chair_1", "chair", box, 0), ("s", "desk_1", "desk", [9.0, 9.0, 10.0, 10.0], 1)], "scene_id string, item_id string, category string, box array<double>, pos int")
    rows = [("a", 0.5, 0.5, "chair_1", None, None, None), ("b", 9.5, 9.5, "chair_1", 9.4, 9.4, None), ("c", 3.0, 0.5, "chair_1", 9.4, 9.4, None), ("d", 5.0, 5.0, None, 5.5, 5.0, None), ("e", 5.0, 5.0, None, None, None, 0.3), ("f", 0.5, 0.5, "chair_1", None, None, None)]
    agents = spark.createDataFrame([(e, "s", x, y, i, tx, ty, d, None, False if e == "f" else None) for e, x, y, i, tx, ty, d in rows], "episode_id string, scene_id string, x double, y double, end_item string, tx double, ty double, d_goal double, goal_radius double, free boolean")
    got = {r.episode_id: (r.method, r.success) for r in joins.object_success(agents, objects).collect()}
    assert got == {"a": ("object", True), "b": ("inferred", True), "c": ("object", False), "d": ("distance", True), "e": ("point", True), "f": ("object", False)}


class Flaky:
    calls = 0

    def chat(self, messages):
        Flaky.calls += 1
        if Flaky.calls % 2:
            raise OSError("try again")
        return messages[0]["content"].upper()


class Broken:
    def chat(self, messages):
        raise OSError("no")


def test_client_is_asked_again(spark):
    df = spark.createDataFrame([(json.dumps([{"role": "user", "content": "a"}]),), (None,)], "messages string").coalesce(1)
    assert [r.answer for r in adapters.asked(df, Flaky, pause=0).collect()] == ["A", None]
    assert [r.answer for r in adapters.asked(df, Broken, retries=1, pause=0).collect()] == [None, None]


def test_failed_judgements_are_false(spark):
    pairs = spark.createDataFrame([("s", "a", "b"), ("s", "c", "d")], "scene_id string, start string, end string")
    got = adapters.judged(pairs, Broken, "?", retries=0, pause=0).collect()
    assert {(r.start, r.meaningful, r.answered) for r in got} == {("a", False, False), ("c", False, False)}


def test_documents_round_trip(spark, tmp_path):
    doc = {"dataset_metadata": {"name": "d"}, "scenes": [{"scene_id": "7", "scene_name": "7", "samples": [
        {"trajectory_id": "0", "instructions": [{"instruction_type": "Area-based", "start": "a_1", "end": "b_1", "generated_instruction": "go"}, "bare"],
         "points": [{"point": "0", "position": [1, 2, 0.5], "rotation": [0, 0, 0, 1]}]}]}]}
    for name in ("0001_000007/train_a.json", "0001_000007/other.json", "0002_000008/broken.json"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(json.dumps(doc) if "broken" not in name else "{")
    files = readers.files(spark, f"{tmp_path}/*", "*.json")
    assert {r.file for r in readers.preferred_files(files).collect()} == {"train_a.json", "broken.json"}
    s = readers.trajectories(spark, str(tmp_path), "train_*.json")
    assert [(r.scene_id, r.trajectory_id) for r in s.collect()] == [("7", "0")]
    assert [(r.instruction_type, r.text) for r in readers.instructions(s).orderBy("instruction_index").collect()] == [("Area-based", "go"), (None, "bare")]
    assert readers.points(s).select("x", "y", "qw").first() == (1.0, 2.0, 1.0)
    assert readers.trajectories(spark, str(tmp_path), "broken*.json").count() == 0
    e = episodes.adapted(s).orderBy("instruction_index").collect()
    assert [x.episode_id for x in e] == ["0-0", "0-1"] and e[0].goals[0].position == [1.0, 2.0, 0.5]


def test_labels_in_both_forms(spark, tmp_path):
    rows = [{"label": "chair", "ins_id": "1", "bounding_box": [{"x": 0, "y": 0, "z": 0}, {"x": 1, "y": 2, "z": 3}]}, {"label": " "}]
    for name, doc in (("a", rows), ("b", {"labels": rows})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "labels.json").write_text(json.dumps(doc))
    got = readers.labels(spark, f"{tmp_path}/*")
    assert got.groupBy("scene_id").count().orderBy("scene_id").collect() == [("a", 2), ("b", 2)]
    boxes = got.select(text.label_or_unknown(F.col("label")).alias("l"), geometry.corners_box(F.col("bounding_box")).alias("b")).collect()
    assert {(r.l, r.b.z1 if r.b else None) for r in boxes} == {("chair", 3.0), ("unknown", None)}


def test_occupancy(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "g.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes([0, 1, 2, 3, 4, 5]))
    got = readers.occupancy(spark, f"{tmp_path}/*/g.pgm").orderBy("row", "col").collect()
    assert [r.v for r in got] == [0, 1, 2, 3, 4, 5] and got[-1].row == 1


def test_missing_mapping_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.mappings(spark, {"val": f"{tmp_path}/none.json"})


def test_pending_scenes_and_parts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "scene_id string, v int")
    out = f"{tmp_path}/out"
    assert writers.pending(df, out).count() == 2
    writers.by_scene(df.where("scene_id = 'a'"), out)
    assert [r.scene_id for r in writers.pending(df, out).collect()] == ["b"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.by_scene(df, out)
    writers.by_scene(df, out, overwrite=True)
    assert writers.pending(df, out).count() == 0
    samples = spark.range(25).select(F.col("id").cast("string").alias("video_id"))
    m = writers.annotation_parts(samples, f"{tmp_path}/parts", 10)
    assert sorted(r.n for r in m.collect()) == [5, 10, 10]
    assert spark.read.json(f"{tmp_path}/parts").count() == 25
    assert writers.manifest(m, samples).first().parts == 3


def test_templates(spark):
    assert value(spark, text.filled(F.lit("a ID b ID"), {"ID": F.lit("7")})) == "a 7 b 7"
    assert value(spark, text.checked_template(F.lit("ID ID"), "ID", 2)) == "ID ID"
    with pytest.raises(Exception, match="must hold"):
        value(spark, text.checked_template(F.lit("ID"), "ID", 2))


def test_online_fold_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"e{k}", i, float(i), rng.random(), rng.random(), 0.0, rng.random() < 0.3) for k in range(3) for i in range(20)]
    schema = "episode_id string, seq int, t double, x double, y double, z double, collided boolean"
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = online.online_measures(stream).writeStream.outputMode("update").format("memory").queryName("online").option("checkpointLocation", f"{tmp_path}/c").start()
    try:  # timeouts by the clock keep batches coming, so the query never has nothing to do
        for _ in range(240):
            if q.exception() or spark.sql("SELECT * FROM online WHERE n_samples = 20").count() == 3:
                break
            time.sleep(0.25)
    finally:
        q.stop()
    got = {r.episode_id: r for r in spark.sql("SELECT * FROM online").collect() if r.n_samples == 20}
    batch = measures.evaluated(spark.createDataFrame(rows, schema)).collect()
    lengths = {r.episode_id: r.path_length for r in measures.evaluated(spark.createDataFrame(rows, schema), names=["path_length"]).collect()}
    assert len(got) == 3
    for r in batch:
        g = got[r.episode_id]
        assert (g.collision_count, g.integrated_collision_penalty, g.episode_time) == (r.collision_count, pytest.approx(r.integrated_collision_penalty), r.episode_time)
        assert g.path_length == pytest.approx(lengths[r.episode_id])
