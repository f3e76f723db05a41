"""Further operators on literals: tasks, commands, pictures, frames and files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry, text
from waymark.operators import annotations, episodes, joins, measures, selection
from waymark.sources import readers, writers
from waymark.streaming import online


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("task", "said"),
    [("vln", "second"), ("objectnav", "Find the chair"), ("pointnav", "Navigate to coordinates (1.00, 2.50, 0.00)"), ("imgnav", "Navigate to the location that matches the target image"), ("nogoalnav", "second")],
)
def test_instructions_of_tasks(spark, task, said):
    goal = F.array(F.lit(1.0), F.lit(2.5), F.lit(0.0))
    assert value(spark, episodes.instruction_for(F.lit(task), F.array(F.lit("first"), F.lit("second")), F.lit(3), F.lit("chair"), goal)) == said


def test_default_instructions(spark):
    none = F.array().cast("array<string>")
    ask = lambda t: value(spark, episodes.instruction_for(F.lit(t), none, F.lit(0), F.lit("x"), F.array(F.lit(0.0))))
    assert ask("vln") == "Navigate to the destination" and ask("nogoalnav").startswith("Explore this environment")


def test_episodes_for_tasks(spark):
    e = spark.createDataFrame([("1", ("To the Chair",), [[0.0, 0.0, 0.5], [1.0, 2.0, 0.5]])], "episode_id string, instruction struct<instruction_text:string>, gt_locations array<array<double>>")
    r = episodes.for_task(e, "objectnav").first()
    assert (r.target_object, r.target_object_position) == ("chair", [1.0, 2.0, 0.5])
    assert episodes.for_task(e, "pointnav").first().goal_position == [1.0, 2.0, 0.5]
    assert episodes.for_task(e, "nogoalnav").first().start_position == [0.0, 0.0, 0.5]
    with pytest.raises(ValueError):
        episodes.for_task(e, "other")


def test_image_tasks_without_a_likeness_go_by_position(spark):
    ask = lambda d, s: value(spark, episodes.reached(F.lit("imgnav"), F.lit(d), F.lit(s).cast("double"), F.lit(False), F.lit(0.0), F.lit(0.0)))
    assert [ask(0.9, None), ask(0.9, 0.7), ask(0.9, 0.9), ask(1.1, 0.9)] == [True, False, True, False]


def test_durations(spark):
    assert [value(spark, text.duration_text(F.lit(s))) for s in (59.94, 90.0, 5400.0)] == ["59.9s", "1.5min", "1.5h"]


def test_trajectory_commands(spark):
    def ask(points, angle=0.0):
        p = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points)) if points else F.array().cast("array<struct<x:double,y:double>>")
        return value(spark, text.trajectory_command(p, F.lit(angle)))

    r = ask([(0, 0), (0.1, 0), (0.2, 0.0)])
    assert (r.vx, r.vy, r.yaw_rate) == (pytest.approx(-0.3), pytest.approx(0), 0)
    r = ask([(0, 0), (1, 0), (1, 1)])
    assert (r.vx, r.yaw_rate) == (pytest.approx(-0.5), pytest.approx(math.radians(60)))
    assert tuple(ask([])) == tuple(ask([(0, 0), (0.001, 0)])) == (0, 0, 0)


def test_numbered_actions_move(spark):
    assert value(spark, text.action_velocity(F.lit(2))).yaw_rate == pytest.approx(math.radians(30))
    assert [value(spark, text.action_velocity(F.lit(k))).stop for k in (0, 1, 3)] == [True, False, False]


def test_start_headings(spark):
    for a in (-3.0, 0.0, 1.0, 3.0):
        want = a - math.pi
        want += 2 * math.pi if want < -math.pi else 0
        assert value(spark, geometry.start_yaw(F.lit(-math.sin(a / 2)), F.lit(math.cos(a / 2)))) == pytest.approx(want)


def test_body_velocities_turn(spark):
    x, y = geometry.body_to_world(F.lit(1.0), F.lit(0.0), F.lit(math.pi / 2))
    assert (value(spark, x), value(spark, y)) == (pytest.approx(0), pytest.approx(1))


def test_custom_measures_register(spark):
    @measures.measure("mean_step")
    def mean_step():
        return F.avg("moved")

    try:
        s = spark.createDataFrame([("e", i, float(i), float(i), 0.0, 0.0, False) for i in range(3)], "episode_id string, seq int, t double, x double, y double, z double, collided boolean")
        assert measures.evaluated(s, names=["mean_step"]).first().mean_step == pytest.approx(2 / 3)
    finally:
        del measures.MEASURES["mean_step"]


def test_pictures(spark):
    f = spark.createDataFrame([("s", 2, "0", "p"), ("s", 1, "10", "q"), ("s", 1, "9", "r")], "scene_id string, part int, trajectory_id string, path string")
    assert {r.path: r.target for r in writers.renumbered_pictures(f).collect()} == {"r": "trajectory_0_vis.png", "q": "trajectory_1_vis.png", "p": "trajectory_2_vis.png"}
    files = spark.createDataFrame([("s", "a.json"), ("s", "b.json")], "scene_id string, file string")
    have = spark.createDataFrame([("s", "a_visualizations")], "scene_id string, folder string")
    assert [r.file for r in writers.without_pictures(files, have).collect()] == ["b.json"]


def test_image_metadata(spark):
    f = spark.createDataFrame([("s", "1", 0, k, f"f{k}") for k in (2, 0, 1)], "scene_id string, trajectory_id string, instruction_index int, pos int, frame string")
    got = json.loads(writers.image_metadata(f).first().value)["sequences"]
    assert got == [{"trajectory_id": "1", "instruction_index": 0, "frame_filenames": ["f0", "f1", "f2"], "sampling_info": {"generated_images_count": 3}}]
    expected = spark.createDataFrame([("s", "1", 3), ("s", "2", 1)], "scene_id string, trajectory_id string, expected int")
    assert [r.trajectory_id for r in episodes.unfinished_images(expected, f).collect()] == ["2"]


def test_readers_of_lists(spark, tmp_path):
    (tmp_path / "0001").mkdir()
    (tmp_path / "0001" / "semantic.json").write_text(json.dumps([{"category_id": 3, "category_label": "chair", "item_id": "chair_1", "bbox_m": ["0", "x", "1.5", "2"], "area": 4}]))
    (tmp_path / "0001" / "prompt.json").write_text(json.dumps([{"role": "system", "content": "a"}, {"role": "user", "content": "b"}]))
    (tmp_path / "0001" / "actions.json").write_text(json.dumps({"groundtruth_data": [{"trajectory_id": "1", "instruction_index": 0, "action_sequence": ["STOP"]}]}))
    (tmp_path / "0001" / "images.json").write_text(json.dumps({"sequences": [{"scene_id": "z", "trajectory_id": "1", "instruction_index": 0, "frame_filenames": ["f"]}]}))
    (tmp_path / "0001" / "0042.usdz").write_text("x")
    (tmp_path / "0001" / "scene.txt").write_text("a hall")
    m = readers.semantic_map(spark, f"{tmp_path}/*/semantic.json").select("scene_id", "item_id", "area", readers.numbers(F.col("bbox_m")).alias("b")).first()
    assert (m.scene_id, m.item_id, m.area, m.b) == ("0001", "chair_1", 4, [0.0, None, 1.5, 2.0])
    assert [r.role for r in readers.prompts(spark, f"{tmp_path}/*/prompt.json").collect()] == ["system", "user"]
    assert readers.ground_truth(spark, f"{tmp_path}/*/actions.json").select("scene_id", "action_sequence").first() == ("0001", ["STOP"])
    assert readers.images(spark, f"{tmp_path}/*/images.json").select("scene_id", "frame_filenames").first() == ("z", ["f"])
    assert [r.stem for r in readers.numbered_files(readers.files(spark, f"{tmp_path}/*")).collect()] == ["0042"]
    scenes = spark.createDataFrame([("0001",), ("0002",)], "scene_id string")
    texts = readers.documents(spark, f"{tmp_path}/*/scene.txt")
    assert {r.scene_id: r.text for r in readers.scene_texts(scenes, texts).collect()} == {"0001": "a hall", "0002": ""}
    assert [r.scene_id for r in readers.scene_files(spark, str(tmp_path), "scene.txt", limit=1).collect()] == ["0001"]


def test_mappings_give_rows(spark, tmp_path):
    doc = {"split_type": "val", "scenes": {"7": {"scene_id": "7", "trajectories": [{"trajectory_id": "1", "instruction_count": 2, "selected_instruction_indices": [0, 2]}]}, "8": {"scene_id": "8"}}}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    got = {(r.scene_id, r.trajectory_id, tuple(r.selected or ())) for r in readers.mappings(spark, {"val": f"{tmp_path}/m.json"}).collect()}
    assert got == {("7", "1", (0, 2)), ("8", None, ())}


def test_physical_map_leaves_gaps(spark):
    good = [(0.0, 0.0, 0.0), (1.0, 2.0, 3.0)]
    rows = [("s", 0, "a", good), ("s", 1, "a", []), ("s", 2, "a", None), ("s", 3, "a", good), ("s", 4, " ", good)]
    df = spark.createDataFrame(rows, "scene_id string, pos int, label string, bounding_box array<struct<x:double,y:double,z:double>>")
    assert [(r.key, r.bounds) for r in annotations.physical_map(df).orderBy("pos").collect()] == [(k, "(0.00,0.00,0.00),(1.00,2.00,3.00)") for k in ("a_1", "a_3", "unknown_1")]


def test_parts_up_to_a_gap(spark):
    df = spark.createDataFrame([("s", p) for p in (1, 2, 3, 5)] + [("t", 2), ("u", 1)], "scene_id string, part int")
    assert {r.scene_id: r.next_part for r in joins.next_part(df).collect()} == {"s": 4, "t": 3, "u": 2}
    assert joins.contiguous_parts(df).groupBy("scene_id").count().orderBy("scene_id").collect() == [("s", 3), ("u", 1)]


def test_index_complement_of_none(spark):
    assert value(spark, selection.complement(F.lit(0), F.array(F.lit(1)))) == [] and value(spark, selection.complement(F.lit(3), F.array(F.lit(1)))) == [0, 2]


def test_resumable_sink_leaves_out_what_is_done(spark):
    got = []
    run = online.resumable(lambda df, epoch: got.extend(r.k for r in df.collect()), lambda: spark.createDataFrame([(1,)], "k int"), ["k"])
    run(spark.createDataFrame([(1,), (2,)], "k int"), 0)
    assert got == [2]


def test_empty_tables(spark):
    s = spark.createDataFrame([], "episode_id string, seq int, t double, x double, y double, z double, collided boolean")
    g = spark.createDataFrame([], "episode_id string, gx double, gy double, gz double, radius double")
    assert measures.evaluated(s, g).count() == 0 and measures.evaluated(s).count() == 0
    runs = spark.createDataFrame([], "file string, ran boolean, skipped boolean, reached boolean, seconds double")
    assert measures.batch_summary(runs).first().completion_rate == 0
    assert selection.parts_of(spark.createDataFrame([], "video_id string"), 10, [F.col("video_id")]).count() == 0
