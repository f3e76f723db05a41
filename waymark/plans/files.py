"""Queries on documents and files: rows of the tables are written in the formats of the datasets and read back.

What is written lies in the scratch folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import actions, adapters, episodes, measures
from ..scratch import fresh_path
from ..sources import readers, writers
from ..streaming import online
from .catalogue import query, table


def put(spark: SparkSession, rows: DataFrame, value: Column, name: str) -> str:
    """One document for each of rows(scene_id, ...); returns where they lie."""
    path = fresh_path(spark, name)
    writers.texts_by_scene(rows.withColumn("value", value), path)
    return path


def named(spark: SparkSession, files: dict[str, str], name: str) -> str:
    """A few small files by their names; returns their folder."""
    root = fresh_path(spark, name)
    system = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for file, value in files.items():
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{file}"))
        out.write(bytearray(value.encode()))
        out.close()
    return root


def _listed(rows: DataFrame, by: Column, order: str, *items: Column) -> DataFrame:
    """(scene_id, items): structs of each scene in order."""
    body = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__at"), F.struct(*items).alias("o"))))
    return rows.groupBy(by.cast("string").alias("scene_id")).agg(F.transform(body, lambda x: x["o"]).alias("items"))


V = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))


@query("read_labels", f"""SELECT CAST(label AS VARCHAR) AS scene_id, CAST(pos AS INTEGER) AS pos, 'Thing ' || vec_id % 4 AS name, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 2 END AS corners, round(CASE WHEN vec_id % 5 > 0 THEN x END, 6) AS x, round(CASE WHEN vec_id % 5 > 0 THEN z + 1 END, 6) AS z FROM ({V})""")
def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations, of every other scene under the key labels."""
    corner = lambda up: F.struct("x", "y", (F.col("z") + up).alias("z"))
    box = F.when(F.col("vec_id") % 5 > 0, F.array(corner(0), corner(1))).otherwise(F.array().cast("array<struct<x:double,y:double,z:double>>"))
    rows = _listed(_vectors(spark, sf_dir), F.col("label"), "vec_id", F.concat(F.lit("Thing "), (F.col("vec_id") % 4).cast("string")).alias("label"), F.col("vec_id").cast("string").alias("ins_id"), box.alias("bounding_box"))
    value = F.when(F.col("scene_id").cast("int") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct(F.col("items").alias("labels"))))
    found = readers.labels(spark, put(spark, rows, value, "labels"))
    b = F.col("bounding_box")
    return found.select("scene_id", "pos", F.col("label").alias("name"), F.size(b).alias("corners"), F.round(F.get(b, F.lit(0))["x"], 6).alias("x"), F.round(F.get(b, F.lit(1))["z"], 6).alias("z"))


@query("read_maps", f"""SELECT CAST(label AS VARCHAR) AS scene_id, CAST(pos AS INTEGER) AS pos, 'thing_' || vec_id AS item_id, CAST(vec_id % 7 AS INTEGER) AS area, CASE WHEN vec_id % 3 > 0 THEN round(x, 2) END AS x, round(y, 2) AS y FROM ({V})""")
def read_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map documents, whose numbers are texts; a text that is no number is null."""
    shown = lambda c: F.round(c, 2).cast("string")
    v = _vectors(spark, sf_dir)
    rows = _listed(v, F.col("label"), "vec_id", F.lit(1).alias("category_id"), F.concat(F.lit("thing_"), F.col("vec_id").cast("string")).alias("item_id"), F.array(F.when(F.col("vec_id") % 3 > 0, shown(F.col("x"))).otherwise("wide"), shown(F.col("y"))).alias("bbox_m"), (F.col("vec_id") % 7).cast("int").alias("area"))
    found = readers.semantic_map(spark, put(spark, rows, F.to_json("items"), "maps"))
    b = readers.numbers(F.col("bbox_m"))
    return found.select("scene_id", "pos", "item_id", "area", b[0].alias("x"), b[1].alias("y"))


@query("read_meta", "SELECT n_name AS scene_id, n_regionkey / 100 AS scale, CAST(n_nationkey AS DOUBLE) AS x0, n_nationkey / 8 AS y0 FROM nation")
def read_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("scene_id"), (F.col("n_regionkey") / 100).alias("scale"), F.array(F.col("n_nationkey").cast("double"), F.col("n_nationkey") / 8, F.lit(0.0)).alias("min"))
    return readers.occupancy_meta(spark, put(spark, n, F.to_json(F.struct("scale", "min")), "meta"))


@query("read_occupancy", "SELECT n_name AS scene_id, CAST(i // 3 AS INTEGER) AS row, CAST(i % 3 AS INTEGER) AS col, CAST((n_nationkey * 10 + i) % 251 AS INTEGER) AS v FROM nation, (SELECT unnest(range(0, 6)) AS i)")
def read_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary image of two rows and three columns for each nation."""
    rows = table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()  # the 25 nations
    root = fresh_path(spark, "images")
    system = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows:
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r.n_name}/occupancy.pgm"))
        out.write(bytearray(b"P5\n# a comment\n3 2\n255\n" + bytes((r.n_nationkey * 10 + i) % 251 for i in range(6))))
        out.close()
    return readers.occupancy(spark, f"{root}/*/occupancy.pgm")


@query("read_mappings", """SELECT 'val' AS split, CAST(o_custkey AS VARCHAR) AS scene_id, CAST(o_orderkey AS VARCHAR) AS trajectory_id, count(*) AS instruction_count, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS selected
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey""")
def read_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping with a scene for each customer, a trajectory for each order and an index for each line."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("at"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    item = F.struct(F.col("o_orderkey").cast("string").alias("trajectory_id"), F.size("at").alias("instruction_count"), F.col("at").alias("selected_instruction_indices"))
    per = o.groupBy(F.col("o_custkey").cast("string").alias("scene_id")).agg(F.collect_list(item).alias("trajectories"))
    # one document for each part of the customers, as a document is one text
    doc = per.groupBy(F.pmod(F.xxhash64("scene_id"), F.lit(16)).cast("string").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("scene_id", F.struct("scene_id", "trajectories")))).alias("scenes"))
    path = put(spark, doc.withColumnRenamed("part", "scene_id"), F.to_json(F.struct(F.lit("val").alias("split_type"), "scenes")), "mappings")
    m = readers.mappings(spark, {"val": f"{path}/*"})
    return m.select("split", "scene_id", "trajectory_id", F.col("instruction_count").cast("long").alias("instruction_count"), F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("selected"))


@query("read_actions", """SELECT CAST(conv_id AS VARCHAR) AS scene_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, 't' || turn AS trajectory_id, CAST(turn AS INTEGER) AS instruction_index, role || ',STOP' AS actions FROM conversations""")
def read_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = _listed(c, F.col("conv_id"), "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("trajectory_id"), F.col("turn").cast("int").alias("instruction_index"), F.array("role", F.lit("STOP")).alias("action_sequence"))
    path = put(spark, rows, F.to_json(F.struct(F.col("items").alias("groundtruth_data"))), "actions")
    return readers.ground_truth(spark, path).select(F.regexp_replace("scene_id", "^scene_id=", "").alias("scene_id"), "pos", "trajectory_id", "instruction_index", F.array_join("action_sequence", ",").alias("actions"))


@query("image_metadata", """SELECT CAST(conv_id AS VARCHAR) AS scene_id, role AS trajectory_id, count(*) AS frames, string_agg('f' || turn, ',' ORDER BY turn) AS names FROM conversations GROUP BY ALL""")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a scene's pictures, written and read back."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("scene_id"), F.col("role").alias("trajectory_id"), F.lit(0).alias("instruction_index"), F.col("turn").alias("pos"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("frame"))
    path = fresh_path(spark, "pictures")
    writers.texts_by_scene(writers.image_metadata(c), path)
    found = readers.images(spark, path)
    return found.select(F.regexp_replace("scene_id", "^scene_id=", "").alias("scene_id"), "trajectory_id", F.col("sampling_info.generated_images_count").cast("long").alias("frames"), F.array_join("frame_filenames", ",").alias("names"))


@query("listed_tests", "SELECT 'test_' || n_name || '.json' AS file, r_name AS scene_id FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name < 'ASIA'")
def listed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names say that they are for tests, wherever they lie."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()  # 25
    files = {f"{r.r_name}/{'test' if r.r_name < 'ASIA' else 'train'}_{r.n_name}.json": "{}" for r in n} | {"test_of_nothing.txt": ""}
    return readers.test_files(spark, named(spark, files, "tests")).select("file", "scene_id")


@query("prompt_roles", "SELECT r_name AS scene, 'system' AS role, 'be ' || r_name AS content FROM region UNION ALL SELECT r_name, 'user', 'go' FROM region")
def prompt_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("scene_id"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    path = put(spark, r, F.to_json(F.array(message("system", F.concat(F.lit("be "), F.col("scene_id"))), message("user", F.lit("go")))), "prompts")
    return readers.prompts(spark, f"{path}/*").select(readers.decoded(F.regexp_extract("path", "/scene_id=([^/]+)/", 1)).alias("scene"), "role", "content")


@query("texts_of_scenes", "WITH t AS (SELECT lang AS scene_id, count(*) || ' texts' AS text FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT doc_id, lang AS scene_id, COALESCE(t.text, '') AS text FROM documents LEFT JOIN t ON lang = scene_id")
def texts_of_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the scenes that have one, written and joined to all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("scene_id"))
    known = d.where("scene_id is not null").groupBy("scene_id").agg(F.count("*").alias("n"))
    path = put(spark, known, F.concat(F.col("n").cast("string"), F.lit(" texts")), "texts")
    return readers.scene_texts(d, readers.documents(spark, f"{path}/*").withColumn("value", F.rtrim("value", F.lit("\n")))).select("doc_id", "scene_id", "text")


@query("sample_lines", "SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, count(*) AS instructions, CAST(max(length(text)) AS DOUBLE) AS x FROM conversations GROUP BY conv_id")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as lines of JSON, written and read back."""
    from .models import samples

    path = fresh_path(spark, "lines")
    writers.sample_lines(samples(spark, sf_dir).withColumn("pos", F.col("trajectory_id").cast("long"))).select("value").write.text(path)
    back = readers.sample_lines(spark, path)
    return back.select("trajectory_id", F.size("instructions").cast("long").alias("instructions"), F.array_max(F.transform("points", lambda p: p["position"][0])).alias("x"))


@query("written_by_scene", "SELECT o_orderpriority AS scene_id, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL")
def written_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in folders of their scenes: written, some replaced by themselves, and read back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scene_id"), F.col("o_totalprice").alias("p"))
    path = fresh_path(spark, "orders")
    writers.by_scene(o, path)
    writers.by_scene(o.where("scene_id < '3'"), path, overwrite=True)
    return spark.read.parquet(path).groupBy("scene_id").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("price"))


@query("pending_scenes", "SELECT o_orderpriority AS scene_id, count(*) AS n FROM orders WHERE o_orderpriority >= '3' GROUP BY ALL")
def pending_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of scenes that are not written yet."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scene_id"), "o_orderkey")
    path = fresh_path(spark, "orders")
    writers.by_scene(o.where("scene_id < '3'"), path)
    return writers.pending(o, path).groupBy("scene_id").agg(F.count("*").alias("n"))


@query("appended_rows", "SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY ALL")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "appended")
    for _ in range(2):
        writers.append(table(spark, sf_dir, "nation").select("n_regionkey"), path)
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("training_manifest", "SELECT CAST(ceil(count(*) / 100) AS BIGINT) AS parts, least(count(*), 100) AS largest, count(*) AS samples, count(DISTINCT conv_id) AS videos FROM conversations")
def training_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in parts of 100, and their manifest."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), "turn", "text")
    parts = writers.annotation_parts(c, fresh_path(spark, "parts"), 100, [F.xxhash64("video_id", "turn"), F.col("video_id"), F.col("turn")])
    return writers.manifest(parts, c).select(F.col("parts").cast("long").alias("parts"), F.col("largest").cast("long").alias("largest"), "samples", "videos")


@query("episode_records", "SELECT source AS scene_name, count(*) AS n, sum(length(text)) AS chars FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY ALL")
def episode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each episode and what is known of it, in folders of scenes."""
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.col("doc_id").alias("episode_id"), F.col("source").alias("scene_name"), F.length("text").cast("long").alias("chars"))
    path = fresh_path(spark, "records")
    writers.measurements(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_id"), "quality"), path)
    back = spark.read.schema("episode_id long, chars long, quality int, scene_name string").json(path)
    return back.groupBy("scene_name").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("summary_row", "SELECT count(*) AS rows, max(o_orderkey) AS last FROM orders")
def summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "summary")
    writers.summary(table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), F.max("o_orderkey").alias("last")), path)
    return spark.read.schema("rows long, last long").json(path)


@query("renumbered_pictures", "SELECT l_orderkey, l_linenumber, 'trajectory_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) || '_vis.png' AS target FROM lineitem")
def renumbered_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("part"), F.col("l_partkey").cast("string").alias("trajectory_id"), F.lit("p").alias("path"))
    return writers.renumbered_pictures(files).select("l_orderkey", "l_linenumber", "target")


@query("unseen_files", "SELECT doc_id || '.json' AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unseen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory files without a folder of pictures."""
    files = table(spark, sf_dir, "documents").select(F.lit("s").alias("scene_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("file"))
    folders = table(spark, sf_dir, "labels").select(F.lit("s").alias("scene_id"), F.concat(F.col("doc_id").cast("string"), F.lit("_visualizations")).alias("folder"))
    return writers.without_pictures(files, folders).select("file")


@query("filled_templates", "SELECT CAST(n_nationkey AS VARCHAR) AS scene_id, 'def \"' || n_name || '\" at ' || n_nationkey AS value FROM nation")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled for each scene, written and read back."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("scene_id"), "n_name")
    template = text.checked_template(F.lit('def "{name}" at {id}'), "{name}", 1)
    filled = episodes.scene_files(n, template, {"{name}": F.col("n_name"), "{id}": F.col("scene_id")})
    path = fresh_path(spark, "filled")
    writers.texts_by_scene(filled, path)
    return readers.documents(spark, f"{path}/*").select("scene_id", F.rtrim("value", F.lit("\n")).alias("value"))


@query("frame_paths", "SELECT conv_id, turn, 's' || conv_id || '/images/trajectory_' || role || '/' || turn || '.png' AS path FROM conversations")
def frame_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    frame = F.concat(F.col("turn").cast("string"), F.lit(".png"))
    return c.select("conv_id", "turn", text.frame_path(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.col("role"), frame).alias("path"))


@query("durations", """SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fmin', s / 60) ELSE printf('%.1fh', s / 3600) END AS shown FROM (SELECT event_id, floor(value * value) + 0.2 AS s FROM events)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.duration_text(F.floor(F.col("value") * F.col("value")) + 0.2).alias("shown"))


@query("body_velocities", "SELECT event_id, round(value * cos(a) - 2 * sin(a), 6) AS vx, round(value * sin(a) + 2 * cos(a), 6) AS vy FROM (SELECT event_id, value, user_id / 10 AS a FROM events)")
def body_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.body_to_world(F.col("value"), F.lit(2.0), F.col("user_id") / 10)
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("vx"), F.round(y, 6).alias("vy"))


@query("start_headings", """WITH a AS (SELECT event_id, (value % 6.2) - 3.1 AS a FROM events), y AS (SELECT event_id, 2 * atan2(sin(a / 2), cos(a / 2)) - pi() AS y FROM a)
SELECT event_id, round(CASE WHEN y > pi() THEN y - 2 * pi() WHEN y < -pi() THEN y + 2 * pi() ELSE y END, 6) AS heading FROM y""")  # fmt: skip
def start_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("value") % 6.2 - 3.1
    return table(spark, sf_dir, "events").select("event_id", F.round(geometry.start_yaw(-F.sin(a / 2), F.cos(a / 2)), 6).alias("heading"))


@query("turned_quaternions", """WITH q AS (SELECT event_id, (value % 3) AS a, (user_id % 10) / 10 AS t FROM events)
SELECT event_id, round(sin(0.4 + t * a), 5) AS z, round(cos(0.4 + t * a), 5) AS w FROM q""")  # fmt: skip
def turned_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between a rotation and one that differs by less than half a turn, the angle goes evenly."""
    q = lambda angle: F.array(F.lit(0.0), F.lit(0.0), F.sin(angle), F.cos(angle))
    a, t = F.lit(0.4), F.col("user_id") % 10 / 10
    b = a + F.col("value") % 3
    # beyond a right angle the other sign of the quaternion is nearer
    far = F.col("value") % 3 > 1.5707963
    found = geometry.slerp(q(a), q(F.when(far, a + F.col("value") % 3 / 2).otherwise(b)), t)
    found = F.when(far, geometry.slerp(q(a + t * (F.col("value") % 3)), q(b), F.lit(0.0))).otherwise(found)
    return table(spark, sf_dir, "events").select("event_id", F.round(found[2], 5).alias("z"), F.round(found[3], 5).alias("w"))


@query("points_to_commands", """WITH p AS (SELECT event_id, value / 100 AS x, (user_id % 7) / 10 AS y FROM events),
c AS (SELECT event_id, -x * 3 AS vx, y * 3 AS vy, sqrt(x * x + y * y) AS d FROM p)
SELECT event_id, round(CASE WHEN d > 0.01 THEN vx * least(1, 0.5 / sqrt(vx * vx + vy * vy)) ELSE 0 END, 6) AS vx, round(CASE WHEN d > 0.01 THEN vy * least(1, 0.5 / sqrt(vx * vx + vy * vy)) ELSE 0 END, 6) AS vy FROM c""")  # fmt: skip
def points_to_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The velocity toward the first of a model's points that is not where the agent stands."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(point(F.lit(0), F.lit(0)), point(F.col("value") / 100, F.col("user_id") % 7 / 10))
    c = text.trajectory_command(points, F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(c["vx"], 6).alias("vx"), F.round(c["vy"], 6).alias("vy"))


@query("task_goals", "WITH l AS (SELECT conv_id, CAST(arg_max(length(text), turn) AS DOUBLE) AS x, CAST(max(turn) AS DOUBLE) AS y FROM conversations GROUP BY conv_id) SELECT conv_id || '-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS episode_id, x, y FROM conversations JOIN l USING (conv_id)")
def task_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes as those of a task with a goal."""
    from .models import samples

    e = episodes.for_task(episodes.adapted(samples(spark, sf_dir)), "pointnav")
    return e.select("episode_id", F.col("goal_position")[0].alias("x"), F.col("goal_position")[1].alias("y"))


@query("told_instructions", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN lang IS NULL THEN 'Navigate to the destination' ELSE lang END WHEN 1 THEN 'Find the cup' WHEN 2 THEN 'Navigate to coordinates (1.00, 2.50, 0.00)' ELSE 'Navigate to the location that matches the target image' END AS said FROM documents""")
def told_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.get(F.array(*(F.lit(t) for t in ("vln", "objectnav", "pointnav", "imgnav"))), (F.col("doc_id") % 4).cast("int"))
    texts = F.when(F.col("lang").isNull(), F.array().cast("array<string>")).otherwise(F.array("lang"))
    goal = F.array(F.lit(1.0), F.lit(2.5), F.lit(0.0))
    return table(spark, sf_dir, "documents").select("doc_id", episodes.instruction_for(task, texts, F.col("doc_id").cast("int"), F.lit("cup"), goal).alias("said"))


@query("exploration_ends", "SELECT event_id, event_type = 'error' OR value >= 80 AS over FROM events")
def exploration_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", episodes.exploration_over(F.col("event_type") == "error", F.col("value")).alias("over"))


@query("unfinished_images", "SELECT CAST(o_orderkey AS VARCHAR) AS trajectory_id, count(l_linenumber) AS images FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_linenumber) < 4")
def unfinished_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.lit("s").alias("scene_id"), F.col("o_orderkey").cast("string").alias("trajectory_id"), F.lit(4).alias("expected"))
    made = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("scene_id"), F.col("l_orderkey").cast("string").alias("trajectory_id"))
    return episodes.unfinished_images(expected, made).select("trajectory_id", "images")


@query("batch_progress", """WITH r AS (SELECT user_id AS batch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS seconds, event_type = 'purchase' AS reached FROM events)
SELECT batch, seq, round(avg(CAST(reached AS DOUBLE)) OVER (PARTITION BY batch ORDER BY seq), 6) AS share, round(greatest(0, 100 - seq) * avg(seconds) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS eta FROM r""")  # fmt: skip
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), place.cast("long").alias("seq"), F.col("value").alias("seconds"), (F.col("event_type") == "purchase").alias("reached"))
    return measures.progress(r, 100).select("batch", "seq", F.round("reached_share", 6).alias("share"), F.round("eta", 4).alias("eta"))


@query("enough_answers", "SELECT CAST(sum(n) AS BIGINT) AS rows FROM (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey < 3 GROUP BY ALL)")
def enough_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region, asked region by region until eleven are there."""
    n = table(spark, sf_dir, "nation")
    path = fresh_path(spark, "enough")
    adapters.until_enough((n.where(F.col("n_regionkey") == k) for k in range(5)), lambda df: df.select("n_name"), 11, path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


@query("resumed_writes", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL")
def resumed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that is given rows twice and writes each once."""
    path = fresh_path(spark, "resumed")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    n.where("n_regionkey < 2").write.parquet(path)
    online.resumable(lambda batch, epoch: batch.write.mode("append").parquet(path), lambda: spark.read.parquet(path), ["n_nationkey"])(n, 0)
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("folded_steps", """WITH s AS (SELECT user_id, event_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type = 'error' AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
d AS (SELECT *, COALESCE(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS moved FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, count(*) AS n_samples, round(sum(moved), 4) AS path_length, count(*) FILTER (WHERE c) AS collisions FROM d GROUP BY user_id""")  # fmt: skip
def folded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online fold, over all steps of an episode at once."""
    import pandas as pd

    def run(steps: pd.DataFrame) -> pd.DataFrame:
        half = len(steps) // 2
        ordered = steps.sort_values("seq")
        state = online.fold(online.fold(None, ordered.iloc[:half]) if half else None, ordered.iloc[half:])
        return pd.DataFrame([(steps["user_id"].iloc[0], state[0], round(state[4], 4), state[5])], columns=["user_id", "n_samples", "path_length", "collisions"])

    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("value").alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.lit(0.0).alias("z"), (F.col("event_type") == "error").alias("collided"))
    return e.groupBy("user_id").applyInPandas(run, "user_id long, n_samples long, path_length double, collisions long")


@query("own_measures", """WITH s AS (SELECT user_id AS episode_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), d AS (SELECT *, COALESCE(abs(x - lag(x) OVER (PARTITION BY episode_id ORDER BY i)), 0) AS moved FROM s)
SELECT episode_id, round(max(moved), 6) AS longest_step FROM d GROUP BY episode_id""")  # fmt: skip
def own_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure that a caller registers."""
    if "longest_step" not in measures.MEASURES:
        measures.measure("longest_step")(lambda: F.max("moved"))
    try:
        e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("t"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(False).alias("collided"))
        return measures.evaluated(e, names=["longest_step"]).select("episode_id", F.round("longest_step", 6).alias("longest_step"))
    finally:
        measures.MEASURES.pop("longest_step", None)


@query("contiguous_videos", """WITH v AS (SELECT conv_id AS video_id, turn, length(text) > 60 AS there FROM conversations), c AS (SELECT *, min(turn) FILTER (WHERE NOT there) OVER (PARTITION BY video_id) AS cut FROM v)
SELECT video_id, count(*) AS frames FROM c WHERE cut IS NULL OR turn < cut GROUP BY video_id""")  # fmt: skip
def contiguous_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a video up to the first that is missing."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), F.col("role").alias("frame"), (F.length("text") > 60).alias("there"))
    return actions.contiguous_frames(c).select("video_id", F.size("frames").cast("long").alias("frames"))


@query("candidates_on_the_map", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND lang IS NOT NULL")
def candidates_on_the_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled things that the map has too."""
    from ..operators import joins

    named = table(spark, sf_dir, "documents").where("lang is not null").select(F.lit("s").alias("scene_id"), F.col("doc_id").cast("string").alias("item_id"), "doc_id")
    there = table(spark, sf_dir, "labels").select(F.lit("s").alias("scene_id"), F.col("doc_id").cast("string").alias("item_id"))
    return joins.on_the_map(named, there).select("doc_id")


@query("obstacle_grid", """WITH o AS (SELECT vec_id, label, CAST(round_even(embedding[1]::DOUBLE * 40, 0) AS INTEGER) AS r, CAST(round_even(embedding[2]::DOUBLE * 40, 0) AS INTEGER) AS c FROM embeddings),
e AS (SELECT min(r) AS r0, min(c) AS c0, ceil((max(r) * 0.05::DOUBLE - min(r) * 0.05::DOUBLE) / 0.05::DOUBLE) + 1 AS h, ceil((max(c) * 0.05::DOUBLE - min(c) * 0.05::DOUBLE) / 0.05::DOUBLE) + 1 AS w FROM o),
d AS (SELECT i, j FROM (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(range(-4, 5)) AS j) WHERE i * i + j * j <= 16)
SELECT DISTINCT CAST(r - r0 + i AS INTEGER) AS row, CAST(c - c0 + j AS INTEGER) AS col FROM o, e, d WHERE label % 5 < 2 AND r - r0 + i >= 0 AND r - r0 + i < h AND c - c0 + j >= 0 AND c - c0 + j < w""")  # fmt: skip
def obstacle_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells near walls and unusable areas of a map, inside the grid that all its instances span."""
    from ..operators import grid

    v = _vectors(spark, sf_dir)
    near = lambda c: F.bround(F.col(c) * 40) * 0.05
    label = F.when(F.col("label") % 5 == 0, "Wall").when(F.col("label") % 5 == 1, "unable area").otherwise("chair")
    found = v.select(F.lit("s").alias("scene_id"), F.col("vec_id").cast("string").alias("item_id"), label.alias("label"), F.array(F.array(near("x"), near("y"))).alias("coords"))
    return grid.obstacle_cells(found, grid.map_extent(found)).select("row", "col")
