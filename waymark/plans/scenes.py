"""Queries on scene statistics, joins, quotas and splits.

Analogy: a scene is a customer, a trajectory an order, its points and
instructions the order's lines (start and end: return flag and line status,
type: line status), the scene-type dimension nation and region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import joins, selection, stats
from .catalogue import query, table

T = table
TRAJ = """t AS (SELECT o_custkey AS scene_id, o_orderkey AS trajectory_id, o_orderkey AS pos, o_totalprice, o_orderpriority, o_orderstatus FROM orders),
n AS (SELECT l_orderkey AS trajectory_id, count(*) AS n_points FROM lineitem GROUP BY l_orderkey),
i AS (SELECT o_custkey AS scene_id, l_orderkey AS trajectory_id, l_returnflag AS start, l_linestatus AS "end", l_shipdate,
      CASE WHEN l_returnflag = 'N' THEN '' ELSE l_linestatus END AS instruction_type, CASE WHEN l_discount < 0.02 THEN '' ELSE l_returnflag || ' to ' || l_linestatus || ' by ' || l_linenumber END AS text
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trajectory_id")).agg(F.count("*").alias("n_points"))
    o = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("trajectory_id"), F.col("o_orderkey").alias("pos"))
    return o.join(n, "trajectory_id")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trajectory_id"), F.col("l_returnflag").alias("start"), F.col("l_linestatus").alias("end"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_linestatus")).alias("instruction_type"),
        F.when(F.col("l_discount") < 0.02, "").otherwise(F.concat("l_returnflag", F.lit(" to "), "l_linestatus", F.lit(" by "), F.col("l_linenumber").cast("string"))).alias("text"),
    )
    return T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("trajectory_id")).join(li, "trajectory_id")


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.trajectory_info(trajectories(spark, sf_dir), instructions(spark, sf_dir))


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


INFO = f"""WITH {TRAJ}, w AS (SELECT *, CASE WHEN text <> '' THEN len(regexp_extract_all(text, '\\S+')) END AS words FROM i),
p AS (SELECT scene_id, trajectory_id, count(*) AS total_instructions, CAST(COALESCE(sum(words), 0) AS BIGINT) AS total_words, COALESCE(avg(words), 0) AS avg_words,
  array_to_string(list_sort(list(DISTINCT start || ' -> ' || "end")), ',') AS pairs, array_to_string(list_sort(list(DISTINCT start)), ',') AS starts,
  count(*) FILTER (WHERE instruction_type = 'O') AS type_o FROM w GROUP BY ALL),
info AS (SELECT scene_id, trajectory_id, n_points, total_instructions, total_words, avg_words, pairs, starts, type_o FROM t JOIN n USING (trajectory_id) JOIN p USING (scene_id, trajectory_id))"""


@query("trajectory_info", f"{INFO} SELECT * REPLACE (round(avg_words, 6) AS avg_words) FROM info")
def trajectory_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = info(spark, sf_dir).select(
        "scene_id", "trajectory_id", "n_points", "total_instructions", "total_words", "avg_words", F.concat_ws(",", "pairs").alias("pairs"), F.concat_ws(",", "starts").alias("starts"),
        F.coalesce(F.try_element_at("type_counts", F.lit("O")), F.lit(0).cast("long")).alias("type_o"),
    )
    return _r(found, "avg_words")


@query("scene_length_stats", f"""WITH {TRAJ} SELECT scene_id, count(*) AS n, round(avg(n_points), 6) AS avg_length, min(n_points) AS min_length, max(n_points) AS max_length,
  median(n_points) AS median_length, round(COALESCE(stddev_samp(n_points), 0), 6) AS std_length FROM t JOIN n USING (trajectory_id) GROUP BY scene_id""")  # fmt: skip
def scene_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.length_stats(trajectories(spark, sf_dir), "n_points", ["scene_id"]), "avg_length", "std_length")


THRESHOLDS = f"""WITH {TRAJ}, s AS (SELECT scene_id, list_sort(list(n_points)) AS l FROM t JOIN n USING (trajectory_id) GROUP BY scene_id),
h AS (SELECT scene_id, CASE WHEN len(l) < 3 THEN l[1] ELSE l[len(l) // 3 + 1] END AS short, CASE WHEN len(l) < 3 THEN l[len(l)] ELSE l[2 * len(l) // 3 + 1] END AS long FROM s)"""


@query("scene_terciles", f"{THRESHOLDS} SELECT * FROM h")
def scene_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tercile_thresholds(trajectories(spark, sf_dir), "n_points", ["scene_id"])


@query("scene_length_histogram", f"""{THRESHOLDS} SELECT scene_id, count(*) FILTER (WHERE n_points <= short) AS short, count(*) FILTER (WHERE n_points > short AND n_points <= long) AS middle,
  count(*) FILTER (WHERE n_points > long) AS long FROM t JOIN n USING (trajectory_id) JOIN h USING (scene_id) GROUP BY scene_id""")  # fmt: skip
def scene_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trajectories(spark, sf_dir)
    cut = t.join(stats.tercile_thresholds(t, "n_points", ["scene_id"]), "scene_id")
    return stats.histogram(cut.withColumn("category", stats.length_category(F.col("n_points"), F.col("short"), F.col("long"))), "category", ["scene_id"])


@query("global_length_categories", """WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents), s AS (SELECT list_sort(list(n)) AS l FROM w),
h AS (SELECT l[len(l) // 3 + 1] AS short, l[2 * len(l) // 3 + 1] AS long FROM s)
SELECT doc_id, CASE WHEN n <= short THEN 'short' WHEN n <= long THEN 'middle' ELSE 'long' END AS category FROM w, h""")  # fmt: skip
def global_length_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))
    cut = w.join(F.broadcast(stats.global_terciles(w, "n")))  # one row
    return cut.select("doc_id", stats.length_category(F.col("n"), F.col("short"), F.col("long")).alias("category"))


@query("scene_instruction_stats", f"""{INFO} SELECT scene_id, round(avg(total_instructions), 6) AS avg_instructions, CAST(sum(total_instructions) AS BIGINT) AS total_instructions,
  round(sum(total_words) / sum(total_instructions), 6) AS avg_words, CAST(sum(total_words) AS BIGINT) AS total_words FROM info GROUP BY scene_id""")  # fmt: skip
def scene_instruction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.instruction_stats(info(spark, sf_dir), ["scene_id"]), "avg_instructions", "avg_words")


@query("scene_location_stats", f"""WITH {TRAJ} SELECT scene_id, count(DISTINCT start) AS unique_starts, count(DISTINCT "end") AS unique_ends, count(DISTINCT (start, "end")) AS unique_pairs FROM i GROUP BY scene_id""")
def scene_location_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.location_stats(instructions(spark, sf_dir), ["scene_id"])


PAIRS = "q AS (SELECT user_id AS scene_id, event_id AS pos, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start, event_type AS \"end\" FROM events), p AS (SELECT * FROM q WHERE start IS NOT NULL)"
TOP = f"""WITH {PAIRS}, c AS (SELECT scene_id, start, "end", count(*) AS n, min(pos) AS first FROM p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, first, start, "end") AS place FROM c)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = T(spark, sf_dir, "events")
    start = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("scene_id"), F.col("event_id").alias("pos"), start.alias("start"), F.col("event_type").alias("end")).where("start is not null")


@query("top_pairs", f'{TOP} SELECT scene_id, start, "end", n, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10')
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_counts(pairs(spark, sf_dir), ["start", "end"], ["scene_id"], 10, "pos")


@query("top_pairs_overall", f'WITH {PAIRS} SELECT start, "end", count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min(pos), start, "end") AS INTEGER) AS place FROM p GROUP BY start, "end" ORDER BY place LIMIT 20')
def top_pairs_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_counts(pairs(spark, sf_dir), ["start", "end"], [], 20, "pos")


@query("global_pairs", f'WITH {PAIRS} SELECT start, "end", count(*) AS n FROM p GROUP BY ALL')
def global_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.global_pairs(pairs(spark, sf_dir), ["start", "end"], "scene_id")


@query("global_pairs_of_tops", f'{TOP} SELECT start, "end", CAST(sum(n) AS BIGINT) AS n FROM k WHERE place <= 10 GROUP BY ALL')
def global_pairs_of_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.global_pairs(pairs(spark, sf_dir), ["start", "end"], "scene_id", compat=True)


SELECTED = f"""{INFO}, s AS (SELECT CASE WHEN scene_id % 10 = 0 THEN 'test' WHEN scene_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, scene_id, total_instructions,
  CASE WHEN n_points <= 3 THEN 'short' WHEN n_points <= 5 THEN 'middle' ELSE 'long' END AS length_category,
  CASE WHEN c_nationkey < 12 THEN 'home' ELSE 'non_home' END AS scene_type, c_mktsegment AS design_type, type_o, total_instructions - type_o AS type_x
  FROM info JOIN customer ON c_custkey = scene_id)"""


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = info(spark, sf_dir).join(T(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "scene_id"), "scene_id")
    k = F.col("scene_id") % 10
    o = F.coalesce(F.try_element_at("type_counts", F.lit("O")), F.lit(0).cast("long"))
    return s.select(
        F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split"), "scene_id", "trajectory_id", F.col("total_instructions").alias("instruction_count"),
        stats.length_category(F.col("n_points"), F.lit(3), F.lit(5)).alias("length_category"), F.when(F.col("c_nationkey") < 12, "home").otherwise("non_home").alias("scene_type"),
        F.col("c_mktsegment").alias("design_type"), F.create_map(F.lit("O"), o, F.lit("x"), F.col("total_instructions") - o).alias("types"),
    )


@query("split_statistics", SELECTED + " ".join(f"{u} SELECT split, '{m}' AS measure, {m} AS name, CAST(sum(total_instructions) AS BIGINT) AS instructions, count(*) AS trajectories FROM s GROUP BY ALL" for u, m in (("", "length_category"), ("UNION ALL", "scene_type"), ("UNION ALL", "design_type"))))
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.split_statistics(selected(spark, sf_dir))


@query("scaled_type_counts", f"""{SELECTED}, h AS (SELECT split, total_instructions // 2 AS c, total_instructions AS tot, type_o, type_x FROM s),
e AS (SELECT split, 'O' AS name, type_o * c / tot AS v FROM h UNION ALL SELECT split, 'x', type_x * c / tot FROM h)
SELECT split, name, CAST(sum(trunc(v)) AS BIGINT) AS n FROM e GROUP BY ALL""")  # fmt: skip
def scaled_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scaled_types(selected(spark, sf_dir).withColumn("instruction_count", F.floor(F.col("instruction_count") / 2)))


@query("split_type_shares", f"""{SELECTED}, d AS (SELECT DISTINCT split, scene_id, scene_type FROM s)
SELECT split, round(100 * avg(CAST(scene_type = 'home' AS DOUBLE)), 6) AS home_percent, round(100 * avg(CAST(scene_type = 'non_home' AS DOUBLE)), 6) AS non_home_percent FROM d GROUP BY split""")  # fmt: skip
def split_type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = selected(spark, sf_dir).select("split", "scene_id", "scene_type").distinct()
    return _r(stats.type_shares(scenes), "home_percent", "non_home_percent")


@query("train_pairs_by_scene", f"{SELECTED} SELECT scene_id, CAST(sum(total_instructions) AS BIGINT) AS total_instruction_pairs FROM s WHERE split = 'train' GROUP BY scene_id")
def train_pairs_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = selected(spark, sf_dir).where("split = 'train'")
    return s.groupBy("scene_id").agg(F.sum("instruction_count").alias("total_instruction_pairs"))


@query("expected_sequences", """WITH s AS (SELECT o_custkey AS scene_id, o_orderkey // 4 AS trajectory_id, o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) % 7 AS n FROM orders),
f AS (SELECT scene_id, trajectory_id, arg_min(n, pos) AS n FROM s GROUP BY ALL) SELECT scene_id, CAST(sum(n) AS BIGINT) AS expected FROM f GROUP BY scene_id""")  # fmt: skip
def expected_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.floor(F.col("o_orderkey") / 4).alias("trajectory_id"), F.col("o_orderkey").alias("pos"), (F.floor("o_totalprice") % 7).alias("n_instructions"))
    return stats.expected_sequences(o)


@query("numbered_labels", """SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') || '_' || row_number() OVER (PARTITION BY replace(lower(trim(p_name)), ' ', '_') ORDER BY p_partkey) AS item_id FROM part""")
def numbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part")
    return stats.numbered_labels(p, text.normalised_label(F.col("p_name")), [], ["p_partkey"]).select("p_partkey", "item_id")


@query("class_ids", """WITH s AS (SELECT event_type AS label, min(event_id) AS first FROM events GROUP BY event_type), k(label, id) AS (VALUES ('door', 1), ('click', 2), ('wall', 3))
SELECT s.label, CAST(COALESCE(k.id, 3 + row_number() OVER (PARTITION BY k.id IS NULL ORDER BY first, s.label)) AS INTEGER) AS class_id FROM s LEFT JOIN k ON k.label = s.label""")  # fmt: skip
def class_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_ids(T(spark, sf_dir, "events"), "event_type", "event_id", ["door", "click", "wall"])


# Joins


@query("scene_types", """SELECT CAST(n_nationkey AS VARCHAR) AS scene_id, COALESCE(r_name, 'Home') AS design_type, CASE WHEN r_name IS NULL THEN 'home' ELSE 'non_home' END AS scene_type
FROM nation LEFT JOIN region ON r_regionkey * 3 = n_nationkey""")  # fmt: skip
def scene_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = T(spark, sf_dir, "region").select((F.col("r_regionkey") * 3).alias("world_id"), F.col("r_name").alias("design_type"))
    return joins.scene_types(T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scene_id")), types)


@query("selected_samples", """WITH s AS (SELECT o_custkey AS scene_id, o_orderkey % 3 AS trajectory_id, o_orderkey AS pos, o_totalprice FROM orders)
SELECT scene_id, trajectory_id, max(pos) AS pos, round(arg_max(o_totalprice, pos), 2) AS o_totalprice FROM s WHERE trajectory_id < 2 GROUP BY scene_id, trajectory_id""")  # fmt: skip
def selected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), (F.col("o_orderkey") % 3).alias("trajectory_id"), F.col("o_orderkey").alias("pos"), "o_totalprice")
    mapping = s.select("scene_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("trajectory_id")).distinct()
    return _r(joins.selected_samples(mapping, s), "o_totalprice", digits=2)


@query("selected_instructions", """SELECT conv_id AS trajectory_id, turn AS instruction_index, length(text) AS n FROM conversations WHERE turn IN (0, 2, 5)""")
def selected_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "conversations").select(F.lit("all").alias("scene_id"), F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("instruction_index"), F.length("text").cast("long").alias("n"))
    mapping = c.select("scene_id", "trajectory_id").distinct().withColumn("indices", F.array(*(F.lit(k).cast("long") for k in (0, 2, 5))))
    return joins.selected_instructions(mapping, c).drop("scene_id")


@query("actions_with_images", """WITH m AS (SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_partkey, l_suppkey)) AS frames FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS trajectory_id, l_linenumber AS instruction_index, frames FROM orders JOIN m ON l_orderkey = o_orderkey""")  # fmt: skip
def actions_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trajectory_id"), F.col("l_linenumber").alias("instruction_index"), F.struct("l_partkey", "l_suppkey").alias("pos"), F.col("l_partkey").alias("frames"))
    o = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trajectory_id"))
    acts = o.join(images.select("trajectory_id", "instruction_index").distinct(), "trajectory_id")
    return joins.actions_with_images(acts, images)


@query("new_pairs", f"""WITH {PAIRS} SELECT DISTINCT start, "end" FROM p WHERE (start, "end") NOT IN (SELECT (start, "end") FROM p WHERE scene_id = 0)""")
def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return joins.new_pairs(p.select("start", "end").distinct(), p.where("scene_id = 0").select("start", "end"))


@query("train_remainder", """SELECT conv_id AS trajectory_id, turn AS instruction_index FROM conversations WHERE conv_id % 5 <> 0 AND NOT (conv_id % 5 = 1 AND turn % 2 = 0)""")
def train_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "conversations").select(F.lit("all").alias("scene_id"), F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("instruction_index"))
    some = c.where("trajectory_id % 5 = 0").select("scene_id", "trajectory_id").distinct()
    return joins.train_remainder(c, some, c.where("trajectory_id % 5 = 1 and instruction_index % 2 = 0")).drop("scene_id")


@query("without_bad_scenes", """SELECT c_name AS scene_key FROM customer WHERE split_part(c_name, '#', 2) NOT IN (SELECT lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') FROM supplier)""")
def without_bad_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = T(spark, sf_dir, "customer").select(F.replace("c_name", F.lit("#"), F.lit("_")).alias("scene_key"))
    bad = T(spark, sf_dir, "supplier").select(F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0").alias("scene_id"))
    return joins.without_bad_scenes(scenes, bad).select(F.replace("scene_key", F.lit("_"), F.lit("#")).alias("scene_key"))


ITEMS = "m AS (SELECT label AS scene_id, vec_id AS item_id, CASE vec_id % 6 WHEN 0 THEN 'Chair' WHEN 1 THEN 'stool' WHEN 2 THEN 'desk' WHEN 3 THEN 'lamp' WHEN 4 THEN 'door' ELSE 'table' END AS label, CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y FROM embeddings)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "embeddings")
    names = F.array(*(F.lit(x) for x in ("Chair", "stool", "desk", "lamp", "door", "table")))
    return e.select(F.col("label").alias("scene_id"), F.col("vec_id").alias("item_id"), F.get(names, (F.col("vec_id") % 6).cast("int")).alias("label"), (F.col("embedding")[0].cast("double") * 40).alias("x"), (F.col("embedding")[1].cast("double") * 40).alias("y"))


@query("candidate_pairs", f"""WITH {ITEMS}, g AS (SELECT *, CASE WHEN lower(label) IN ('chair', 'stool') THEN 0 WHEN label IN ('desk', 'table') THEN 1 WHEN label = 'lamp' THEN 4 END AS grp FROM m)
SELECT a.scene_id, a.item_id AS start, b.item_id AS "end", round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM g a JOIN g b ON a.scene_id = b.scene_id AND a.item_id <> b.item_id
  AND lower(a.label) <> lower(b.label) AND COALESCE(a.grp <> b.grp, true) WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) BETWEEN 2 AND 20""")  # fmt: skip
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(joins.candidate_pairs(items(spark, sf_dir)), "distance")


OBJECTS = "o AS (SELECT scene_id, CAST(item_id AS VARCHAR) AS item_id, label AS category, x - 0.5 AS x0, y - 0.5 AS y0, x + 0.5 AS x1, y + 0.5 AS y1, item_id AS pos FROM m)"
TARGETS = "a AS (SELECT label AS scene_id, vec_id AS episode_id, CAST(embedding[3] AS DOUBLE) * 40 AS x, CAST(embedding[4] AS DOUBLE) * 40 AS y, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(embedding[5] AS DOUBLE) * 40 END AS tx, CAST(embedding[6] AS DOUBLE) * 40 AS ty, CASE WHEN vec_id % 2 = 0 THEN CAST((vec_id * 7) % 500 AS VARCHAR) END AS end_item FROM embeddings)"
BEST = f"""WITH {ITEMS}, {OBJECTS}, {TARGETS}, near AS (SELECT a.episode_id, o.*, sqrt((a.tx - o.x0 - 0.5) ** 2 + (a.ty - o.y0 - 0.5) ** 2) AS d,
  CASE category WHEN 'desk' THEN 2 WHEN 'table' THEN 2 WHEN 'Chair' THEN 3 ELSE 5 END AS priority FROM a JOIN o ON a.scene_id = o.scene_id WHERE sqrt((a.tx - o.x0 - 0.5) ** 2 + (a.ty - o.y0 - 0.5) ** 2) <= 2),
best AS (SELECT episode_id, count(*) AS candidates, arg_min({{'i': item_id, 'c': category, 'd': d, 'p': priority, 'x0': x0, 'y0': y0}}, (priority, d, pos)) AS b FROM near GROUP BY episode_id)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array(F.col("x") - 0.5, F.col("y") - 0.5, F.col("x") + 0.5, F.col("y") + 0.5)
    return items(spark, sf_dir).select("scene_id", F.col("item_id").cast("string").alias("item_id"), F.col("label").alias("category"), box.alias("box"), F.col("item_id").alias("pos"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "embeddings")
    v = lambda k: F.col("embedding")[k].cast("double") * 40
    return e.select(
        F.col("label").alias("scene_id"), F.col("vec_id").alias("episode_id"), v(2).alias("x"), v(3).alias("y"), F.when(F.col("vec_id") % 3 != 0, v(4)).alias("tx"), v(5).alias("ty"),
        F.when(F.col("vec_id") % 2 == 0, ((F.col("vec_id") * 7) % 500).cast("string")).alias("end_item"), F.hypot(v(2), v(3)).alias("d_goal"), F.lit(20.0).alias("goal_radius"), (F.col("vec_id") % 4 != 1).alias("free"),
    )


@query("best_targets", f"{BEST} SELECT episode_id, candidates, b.i AS item_id, b.c AS category, round(b.d, 6) AS distance, b.p AS priority FROM best")
def best_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = agents(spark, sf_dir).where("tx is not null").select("scene_id", "episode_id", F.col("tx").alias("x"), F.col("ty").alias("y"))
    return _r(joins.best_targets(joins.near_objects(a, objects(spark, sf_dir)), ["episode_id"]).drop("box"), "distance")


@query("object_success", f"""{BEST}, j AS (SELECT a.*, vec.free, vec.dg, o.x0 AS lx, o.y0 AS ly, b.b FROM a JOIN (SELECT vec_id, vec_id % 4 <> 1 AS free, sqrt((embedding[3]::DOUBLE * 40) ** 2 + (embedding[4]::DOUBLE * 40) ** 2) AS dg FROM embeddings) vec ON vec_id = episode_id
  LEFT JOIN o ON o.scene_id = a.scene_id AND o.item_id = a.end_item LEFT JOIN best b ON b.episode_id = a.episode_id),
k AS (SELECT *, lx IS NOT NULL AND x BETWEEN lx - 1 AND lx + 2 AND y BETWEEN ly - 1 AND ly + 2 AS at_label, COALESCE(sqrt((x - lx - 0.5) ** 2 + (y - ly - 0.5) ** 2) > 5, false) AS far FROM j),
m2 AS (SELECT *, CASE WHEN NOT (lx IS NULL OR (NOT at_label AND far)) THEN 'object' WHEN tx IS NULL THEN 'point' WHEN b IS NOT NULL THEN 'inferred' ELSE 'distance' END AS method FROM k)
SELECT episode_id, method, CASE method WHEN 'object' THEN at_label AND free WHEN 'inferred' THEN x BETWEEN b.x0 - 1 AND b.x0 + 2 AND y BETWEEN b.y0 - 1 AND b.y0 + 2 AND free
  WHEN 'distance' THEN sqrt((x - tx) ** 2 + (y - ty) ** 2) <= 1 ELSE dg < 20 END AS success FROM m2""")  # fmt: skip
def object_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.object_success(agents(spark, sf_dir), objects(spark, sf_dir))


@query("nearest_waypoint", """WITH w AS (SELECT user_id, event_id AS seq, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events WHERE event_type = 'view'),
p AS (SELECT user_id, event_id AS position_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events WHERE event_type = 'click')
SELECT p.user_id, position_id, arg_min(w.seq, (sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2), w.seq)) AS nearest, round(min(sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2)), 6) AS distance
FROM p JOIN w USING (user_id) GROUP BY p.user_id, position_id""")  # fmt: skip
def nearest_waypoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    w = e.where("event_type = 'view'").withColumnRenamed("event_id", "seq").drop("event_type")
    return _r(joins.nearest_waypoint(e.where("event_type = 'click'").withColumnRenamed("event_id", "position_id").drop("event_type"), w, "user_id"), "distance")


@query("file_correspondence", """SELECT COALESCE(d.doc_id, p.page_id) AS scene_id, CASE WHEN d.doc_id IS NOT NULL AND p.page_id IS NOT NULL THEN 'complete' WHEN d.doc_id IS NOT NULL THEN 'no_trajectory' ELSE 'no_endpoints' END AS state
FROM (SELECT DISTINCT doc_id FROM labels) d FULL JOIN (SELECT DISTINCT page_id FROM pages) p ON d.doc_id = p.page_id""")  # fmt: skip
def file_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = T(spark, sf_dir, "labels").select(F.col("doc_id").alias("scene_id")), T(spark, sf_dir, "pages").select(F.col("page_id").alias("scene_id"))
    return joins.correspondence(e, t, ["scene_id"])


@query("instructions_with_default", """SELECT doc_id, COALESCE(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def instructions_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T(spark, sf_dir, "documents").select("doc_id")
    return joins.with_default(d, T(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], {"quality": F.lit(-1)})


@query("ranked_file_match", """WITH m AS (SELECT r_name, n_name, CASE WHEN n_name = 'NATION_' || r_regionkey THEN 0 WHEN starts_with(n_name, 'NATION_' || r_regionkey) THEN 1 WHEN contains(n_name, CAST(r_regionkey AS VARCHAR)) THEN 2 END AS rank FROM region, nation)
SELECT r_name, arg_min(n_name, (rank, n_name)) AS file, min(rank) AS rank FROM m WHERE rank IS NOT NULL GROUP BY r_name""")  # fmt: skip
def ranked_file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").cast("string").alias("name"))
    return joins.ranked_match(r, T(spark, sf_dir, "nation").select(F.col("n_name").alias("file")), "name", ["NATION_{}", "NATION_{}*", "*{}*"]).drop("name")


@query("contiguous_parts", """WITH p AS (SELECT l_orderkey AS scene_id, l_linenumber AS part FROM lineitem GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY part) AS k FROM p)
SELECT scene_id, part FROM q WHERE part = k""")  # fmt: skip
def contiguous_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.contiguous_parts(T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("part")).distinct())


@query("next_part", """WITH p AS (SELECT l_orderkey AS scene_id, l_linenumber AS part FROM lineitem GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY part) + 1 AS k FROM p WHERE part >= 2),
f AS (SELECT scene_id, max(part) + 1 AS next_part FROM q WHERE part = k GROUP BY scene_id) SELECT scene_id, CAST(COALESCE(next_part, 2) AS INTEGER) AS next_part FROM (SELECT DISTINCT scene_id FROM p) LEFT JOIN f USING (scene_id)""")  # fmt: skip
def next_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.next_part(T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("part")).distinct())


@query("preferred_pattern", """WITH f AS (SELECT o_custkey AS scene_id, o_orderpriority || '_' || o_orderkey AS file, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS rank FROM orders)
SELECT scene_id, file, rank FROM f QUALIFY rank = min(rank) OVER (PARTITION BY scene_id)""")  # fmt: skip
def preferred_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.concat_ws("_", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("file"))
    return joins.first_by_pattern(f, ["^1-URGENT_", "^2-HIGH_"])


# Orders, quotas, parts, sets

ORD = "(o_orderkey * 2654435761) % 1000003"


def _order(c: str = "o_orderkey") -> list:
    return [(F.col(c) * 2654435761) % 1000003, F.col(c)]


@query("greedy_quota", f"""WITH b AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY {ORD}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM orders)
SELECT o_custkey, o_orderkey, n FROM b WHERE COALESCE(s, 0) < 600000""")  # fmt: skip
def greedy_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("n"))
    return selection.greedy_quota(o, "n", 600000, ["o_custkey"], _order())


@query("capped_quota", f"""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT o_custkey, o_orderkey, n, least(n // 3 + 1, n) AS w FROM orders JOIN c ON l_orderkey = o_orderkey),
b AS (SELECT *, COALESCE(sum(w) OVER (PARTITION BY o_custkey ORDER BY {ORD}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM j)
SELECT o_custkey, o_orderkey, n, CAST(greatest(0, least(w, 7 - s)) AS BIGINT) AS taken FROM b WHERE greatest(0, least(w, 7 - s)) > 0""")  # fmt: skip
def capped_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = T(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(c, "o_orderkey")
    return selection.capped_quota(j, "n", 7, ["o_custkey"], _order())


@query("trajectory_pool", f"""WITH p AS (SELECT o_custkey AS scene_id, o_orderkey AS trajectory_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {ORD}, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT scene_id, trajectory_id, CAST(place AS INTEGER) AS place FROM p WHERE place <= greatest(1, n // 3)""")  # fmt: skip
def trajectory_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("trajectory_id"))
    return selection.trajectory_pool(o, _order("trajectory_id")[0])


SCENES = "sc AS (SELECT c_custkey AS scene_id, count(*) AS pairs, CASE WHEN c_nationkey < 12 THEN 'home' ELSE 'non_home' END AS scene_type FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey)"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("scene_id")).agg(F.count("*").alias("pairs"))
    c = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scene_id"), F.when(F.col("c_nationkey") < 12, "home").otherwise("non_home").alias("scene_type"))
    return o.join(c, "scene_id").select("scene_id", "pairs", "scene_type")


MID = "WITH {s}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_type ORDER BY pairs, scene_id) - 1 AS i, count(*) OVER (PARTITION BY scene_type) AS n FROM sc), tot AS (SELECT count(*) AS t, count(*) FILTER (WHERE scene_type = 'home') AS h FROM sc), k AS (SELECT *, CASE WHEN scene_type = 'home' THEN least(greatest(1, CAST(floor(40 * (h / t)) AS INTEGER)), h) ELSE least(greatest(1, 40 - greatest(1, CAST(floor(40 * (h / t)) AS INTEGER))), t - h) END AS want FROM r, tot), c AS (SELECT *, row_number() OVER (PARTITION BY scene_type ORDER BY (scene_id * 2654435761) % 1000003, scene_id) AS p FROM k WHERE n <= want OR (i >= n // 4 AND i < n // 4 + 2 * want)) SELECT scene_id, pairs, scene_type FROM c WHERE p <= want"


@query("balanced_scenes", MID.replace("{s}", SCENES))
def balanced_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.balanced_scenes(scenes(spark, sf_dir), 40, (F.col("scene_id") * 2654435761) % 1000003)


@query("dataset_splits")
def dataset_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trajectory_id")).agg(F.count("*").alias("instruction_count"))
    o = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("trajectory_id")).join(t, "trajectory_id")
    found = selection.splits(scenes(spark, sf_dir), o, 20, 15, 1000, 15)
    out = None
    for name, df in found.items():
        one = df.groupBy(F.lit(name).alias("split")).agg(F.count_distinct("scene_id").alias("scenes"), (F.sum("instruction_count") if "instruction_count" in df.columns else F.lit(None).cast("long")).alias("instructions"))
        out = one if out is None else out.unionByName(one)
    return out


@query("part_files", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 2654435761) % 1000003, doc_id) - 1 AS place FROM documents) SELECT doc_id, place, place // 64 AS part FROM r""")
def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.parts_of(T(spark, sf_dir, "documents").select("doc_id"), 64, _order("doc_id"))


@query("batch_chunks", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT source, i // 10 AS chunk, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY i) AS ids FROM r GROUP BY source, i // 10""")  # fmt: skip
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.chunks(T(spark, sf_dir, "documents"), 10, ["source"], ["doc_id"], "doc_id")
    return found.select("source", "chunk", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@query("slice_episodes", "SELECT doc_id, n_chars FROM (SELECT * FROM (SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100) ORDER BY doc_id OFFSET 30) ORDER BY doc_id LIMIT 50")
def slice_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sliced(T(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], most=100, start=30, n=50)


@query("first_scenes", "SELECT c_custkey AS scene_id FROM customer ORDER BY scene_id LIMIT 25")
def first_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_scenes(T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scene_id")), 25)


@query("shards", "SELECT 4 AS shards, count(*) AS scenes FROM customer")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, out = T(spark, sf_dir, "customer"), None
    for k in range(4):
        one = selection.sharded(c, "c_custkey", 4, k).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.count_if(F.col("n") > 0).cast("int").alias("shards"), F.sum("n").alias("scenes"))


@query("merged_parts", """WITH s AS (SELECT o_custkey AS scene_id, year(o_orderdate) AS part, o_orderkey AS pos FROM orders)
SELECT scene_id, part, pos, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY part, pos) - 1 AS VARCHAR) AS trajectory_id FROM s""")  # fmt: skip
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.year("o_orderdate").alias("part"), F.col("o_orderkey").alias("pos"))
    return selection.merged_parts(o)


@query("scene_sets", """SELECT 'both' AS of, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def scene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = T(spark, sf_dir, "documents").select("doc_id"), T(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(lab).select(F.lit("both").alias("of"), "doc_id").unionByName(d.exceptAll(lab.distinct()).select(F.lit("unlabelled").alias("of"), "doc_id"))


@query("index_complement", """WITH c AS (SELECT conv_id, CAST(max(turn) + 1 AS INTEGER) AS n, list(turn) FILTER (WHERE turn % 3 = 0) AS taken FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(range(0, n), lambda i: NOT list_contains(taken, i)), ',') AS rest FROM c""")  # fmt: skip
def index_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("n"), F.collect_set(F.when(F.col("turn") % 3 == 0, F.col("turn").cast("int"))).alias("taken"))
    return c.select("conv_id", F.array_join(F.transform(selection.complement(F.col("n"), F.col("taken")), lambda x: x.cast("string")), ",").alias("rest"))


@query("first_of_each", "SELECT o_custkey AS scene_id, min(o_orderkey) AS trajectory_id FROM orders GROUP BY o_custkey")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("trajectory_id"))
    return selection.first_of_each(o, ["scene_id"], ["trajectory_id"])


# Column functions


@query("aabb", "SELECT vec_id, round(list_min(embedding[1:8])::DOUBLE, 6) AS x0, round(list_max(embedding[1:8])::DOUBLE, 6) AS x1, round(list_max(embedding[17:24])::DOUBLE - list_min(embedding[17:24])::DOUBLE, 6) AS height FROM embeddings")
def aabb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    corners = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get(e, i).alias("x"), F.get(e, i + 8).alias("y"), F.get(e, i + 16).alias("z")))
    b = geometry.corners_box(corners)
    return T(spark, sf_dir, "embeddings").select("vec_id", b.alias("b")).select("vec_id", F.round("b.x0", 6).alias("x0"), F.round("b.x1", 6).alias("x1"), F.round(F.col("b.z1") - F.col("b.z0"), 6).alias("height"))


@query("map_bounds", "SELECT label, min(embedding[2]::DOUBLE) AS x0, max(embedding[2]::DOUBLE) AS x1, min(embedding[1]::DOUBLE) AS y0, max(embedding[1]::DOUBLE) AS y1 FROM embeddings GROUP BY label")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = F.array(F.array(F.col("embedding")[0].cast("double").cast("string"), F.col("embedding")[1].cast("double").cast("string")), F.array(F.lit("no"), F.lit("number")))
    return stats.map_bounds(T(spark, sf_dir, "embeddings").select("label", coords.alias("coords")), ["label"])


@query("mirrored_positions", """WITH b AS (SELECT label, min(embedding[1]::DOUBLE) AS x0, max(embedding[1]::DOUBLE) AS x1 FROM embeddings GROUP BY label)
SELECT vec_id, round(-(x0 + x1 - embedding[1]::DOUBLE), 6) AS x, round(embedding[1]::DOUBLE, 6) AS back FROM embeddings JOIN b USING (label)""")  # fmt: skip
def mirrored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("v"))
    b = e.groupBy("label").agg(F.min("v").alias("x0"), F.max("v").alias("x1"))
    m = e.join(b, "label").withColumn("x", geometry.mirrored(F.col("v"), F.col("x0"), F.col("x1")))
    return m.select("vec_id", F.round("x", 6).alias("x"), F.round(geometry.unmirrored(F.col("x"), F.col("x0"), F.col("x1")), 6).alias("back"))


@query("pixel_cells", "SELECT event_id, CAST(round_even(value / 0.05, 0) AS INTEGER) AS px, CAST(trunc((value - 50) / 0.5) AS INTEGER) AS cell, CAST(greatest(0, least(999, floor(value / 0.4))) AS INTEGER) AS clipped FROM events")
def pixel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return T(spark, sf_dir, "events").select("event_id", geometry.to_pixel(v, 0.0, 0.05).alias("px"), geometry.coarse_cell(v - 50).alias("cell"), geometry.clipped_pixel(v, 0.0, 0.4, 1000).alias("clipped"))


@query("angles", """WITH a AS (SELECT event_id, value / 10 AS a FROM events)
SELECT event_id, round(CASE WHEN a > pi() THEN a - 2 * pi() * ceil((a - pi()) / (2 * pi())) ELSE a END, 6) AS normal, round(a + pi() - 2 * pi() * floor((a + pi()) / (2 * pi())) - pi(), 6) AS turned, round(atan2(2 * cos(a / 2) * sin(a / 2), 1 - 2 * sin(a / 2) ** 2), 6) AS yaw FROM a""")  # fmt: skip
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("a"))
    q = geometry.quaternion(F.col("a"))
    return a.select("event_id", F.round(geometry.normalised(F.col("a")), 6).alias("normal"), F.round(geometry.turned(F.col("a"), F.lit(0.0)), 6).alias("turned"), F.round(geometry.yaw(q[0], q[1], q[2], q[3]), 6).alias("yaw"))


@query("word_counts", "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"))


@query("text_commands", """WITH t AS (SELECT conv_id, turn, lower(CASE turn % 6 WHEN 0 THEN 'Move forward ' || (conv_id % 9) / 10.0 || ' meter' WHEN 1 THEN 'turn left ' || conv_id || ' degrees' WHEN 2 THEN 'Turn right' WHEN 3 THEN 'task done' WHEN 4 THEN 'go back' ELSE text END) AS t FROM conversations),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '(\\d+\\.?\\d*)\\s*(?:meter|metre|m|step)', 1), '') AS DOUBLE) AS d, TRY_CAST(nullif(regexp_extract(t, '(\\d+\\.?\\d*)\\s*(?:degree|deg|°)', 1), '') AS DOUBLE) AS g, regexp_matches(t, 'stop|halt|complete|finish|done') AS stop FROM t)
SELECT conv_id, turn, stop, round(CASE WHEN stop THEN 0 WHEN regexp_matches(t, 'back|reverse') THEN -0.2 WHEN regexp_matches(t, 'forward|ahead|straight|move') THEN CASE WHEN d IS NULL THEN 0.3 ELSE least(d, 0.5) END ELSE 0 END, 6) AS vx,
  round(CASE WHEN stop THEN 0 WHEN contains(t, 'left') THEN radians(COALESCE(g, 30)) WHEN contains(t, 'right') THEN -radians(COALESCE(g, 30)) ELSE 0 END, 6) AS yaw_rate,
  CASE WHEN regexp_matches(t, 'forward|ahead|move|go') THEN 'MOVE_FORWARD' WHEN contains(t, 'left') THEN 'TURN_LEFT' WHEN contains(t, 'right') THEN 'TURN_RIGHT' WHEN regexp_matches(t, 'stop|halt|done|finish') THEN 'STOP' ELSE 'MOVE_FORWARD' END AS action FROM n""")  # fmt: skip
def text_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("turn") % 6, F.col("conv_id")
    t = (
        F.when(k == 0, F.concat(F.lit("Move forward "), ((c % 9) / 10.0).cast("string"), F.lit(" meter"))).when(k == 1, F.concat(F.lit("turn left "), c.cast("string"), F.lit(" degrees")))
        .when(k == 2, "Turn right").when(k == 3, "task done").when(k == 4, "go back").otherwise(F.col("text"))
    )
    x = T(spark, sf_dir, "conversations").select("conv_id", "turn", text.text_command(t).alias("x"), text.action_of(t).alias("action"))
    return x.select("conv_id", "turn", F.col("x.stop").alias("stop"), F.round("x.vx", 6).alias("vx"), F.round("x.yaw_rate", 6).alias("yaw_rate"), "action")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Sure: ```json\n"), F.col("props"), F.lit("\n``` done"))
    return T(spark, sf_dir, "events").select("event_id", F.try_variant_get(text.robust_json(answer), "$.k", "bigint").alias("k"))


@query("scene_keys", "SELECT o_orderkey, CAST(o_orderkey % 100 AS VARCHAR) AS prefix, CAST(o_custkey AS VARCHAR) AS scene, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 ELSE 1 END AS INTEGER) AS part FROM orders")
def scene_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.lit("a/trajectories_"), (k % 100).cast("string"), F.lit("_"), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, F.concat(F.lit("_part"), (k % 7).cast("string"))).otherwise(""), F.lit("_trans.json"))
    found = text.trajectory_key(path)
    return T(spark, sf_dir, "orders").select("o_orderkey", *(v.alias(n) for n, v in found.items()))


@query("physical_map", """WITH l AS (SELECT label AS scene_id, vec_id AS pos, CASE WHEN vec_id % 7 = 0 THEN 'unknown' ELSE 'Chair' END AS name, vec_id % 5 = 1 AS empty, vec_id % 5 = 2 AS missing, embedding AS e FROM embeddings),
n AS (SELECT *, name || '_' || row_number() OVER (PARTITION BY scene_id, name ORDER BY pos) AS key FROM l WHERE NOT missing)
SELECT scene_id, pos, key, printf('(%.2f,%.2f,%.2f),(%.2f,%.2f,%.2f)', least(e[1], e[4])::DOUBLE, least(e[2], e[5])::DOUBLE, least(e[3], e[6])::DOUBLE, greatest(e[1], e[4])::DOUBLE, greatest(e[2], e[5])::DOUBLE, greatest(e[3], e[6])::DOUBLE) AS bounds FROM n WHERE NOT empty""")  # fmt: skip
def physical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import annotations

    e = lambda k: F.col("embedding")[k].cast("double")
    corner = lambda k: F.struct(e(k).alias("x"), e(k + 1).alias("y"), e(k + 2).alias("z"))
    k = F.col("vec_id") % 5
    box = F.when(k == 1, F.array().cast("array<struct<x:double,y:double,z:double>>")).when(k != 2, F.array(corner(0), corner(3)))
    labels = T(spark, sf_dir, "embeddings").select(F.col("label").alias("scene_id"), F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 7 == 0, " ").otherwise(" Chair").alias("label"), box.alias("bounding_box"))
    return annotations.physical_map(labels).drop("box")


@query("skipped_labels", "SELECT label AS scene_id, count(*) AS labels, count(*) FILTER (WHERE vec_id % 5 IN (1, 2)) AS skipped FROM embeddings GROUP BY label")
def skipped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import annotations

    one = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z")))
    k = F.col("vec_id") % 5
    box = F.when(k == 1, F.array().cast("array<struct<x:double,y:double,z:double>>")).when(k != 2, one)
    return annotations.skipped_labels(T(spark, sf_dir, "embeddings").select(F.col("label").alias("scene_id"), box.alias("bounding_box")))


@query("duplicate_pairs", f'WITH {PAIRS} SELECT scene_id, count(*) AS pairs, count(DISTINCT (start, "end")) AS distinct_pairs, round(count(DISTINCT (start, "end")) / count(*), 6) AS ratio, count(DISTINCT (start, "end")) / count(*) < 0.9 AS warned FROM p GROUP BY scene_id')
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import annotations

    return _r(annotations.duplicate_pairs(pairs(spark, sf_dir)), "ratio")


@query("budgeted_pairs", f'WITH {PAIRS}, d AS (SELECT DISTINCT scene_id, start, "end" FROM p) SELECT scene_id, least(count(*), 12) AS n FROM d GROUP BY scene_id')
def budgeted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import annotations

    d = pairs(spark, sf_dir).select("scene_id", "start", "end").distinct()
    return annotations.budgeted_pairs(d, 12).groupBy("scene_id").agg(F.count("*").alias("n"))
