"""Queries on model adapters, tasks, documents and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import adapters, episodes
from ..sources import readers, writers
from ..streaming import online
from .catalogue import query, table
from .episodes import STEPS, steps




@query("judged_pairs", """SELECT source AS scene_id, 'doc_' || doc_id AS start, lang AS "end", ('0x' || substr(md5('doc_' || doc_id || '|' || COALESCE(lang, 'None')), 1, 8))::BIGINT % 2 = 0 AS meaningful, true AS answered FROM documents""")
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pairs = d.select(F.col("source").alias("scene_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("start"), F.col("lang").alias("end"))
    return adapters.judged(pairs, adapters.FakeClient, "Which pairs make sense?", pause=0)


@query("instructed_pairs", """WITH d AS (SELECT source, 'doc_' || doc_id AS start, lang, lang IS NOT NULL AND ('0x' || substr(md5('doc_' || doc_id), 1, 8))::BIGINT % 3 > 0 AS valid FROM documents)
SELECT source AS scene_id, start, lang AS "end", valid, '[{"instruction_type":"' || CASE WHEN valid THEN 'Add_Object' ELSE 'Default' END || '","start":"' || start || '"' || COALESCE(',"end":"' || lang || '"', '')
  || COALESCE(',"generated_instruction":"' || CASE WHEN valid THEN 'Go' ELSE 'Navigate' END || ' from ' || start || ' to ' || lang || '."', '') || COALESCE(',"scene_id":"' || source || '"', '') || '}]' AS instructions FROM d""")
def instructed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pairs = d.select(F.col("source").alias("scene_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("start"), F.col("lang").alias("end"))
    found = adapters.instructed(pairs, adapters.FakeClient, "Write instructions.", pause=0)
    return found.select("scene_id", "start", "end", "valid", F.to_json("instructions").alias("instructions"))


@query("cached_answers", """SELECT event_id, 'I see: ' || event_type || ' ' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS answer FROM events""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("question"))
    call = lambda q: adapters.asked(q.withColumn("messages", F.to_json(F.array(adapters.message("user", F.col("question"))))), adapters.FakeClient).drop("messages")
    return adapters.cached(e, ["question"], call).select("event_id", "answer")


@query("robust_json", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"a":2}' WHEN 2 THEN '[{"a":3},{"a":4}]' WHEN 3 THEN NULL WHEN 4 THEN '[1,2]' ELSE '{"b":[5]}' END AS json FROM documents""")
def robust_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = ['{"a": 1}', 'Sure.\n```json\n{"a": 2}\n```\nBye', 'Two: [{"a": 3}, {"a": 4}] ok', "nothing here", "```\n[1, 2]\n```", 'So {"b": [5]} it is']
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*(F.lit(a) for a in answers)), (F.col("doc_id") % 6).cast("int")).alias("answer"))
    return d.select("doc_id", F.to_json(text.robust_json(F.col("answer"))).alias("json"))


@query("judgements", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'true,true,false' WHEN 1 THEN 'false,false,false' WHEN 2 THEN 'false,false,false' ELSE 'true,true,true' END AS meaningful, doc_id % 4 NOT IN (1, 2) AS answered FROM documents""")
def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = ['[{"meaningful": true}, {"meaningful": "Yes"}, {"meaningful": "no"}]', 'ok [{"meaningful": 1}]', '{"meaningful": true}', '[{"meaningful":"TRUE"},{"meaningful":"1"},{"meaningful":true},{"meaningful":false}]']
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*(F.lit(a) for a in answers)), (F.col("doc_id") % 4).cast("int")).alias("answer"))
    j = text.judgements(F.col("answer"), F.lit(3))
    return d.select("doc_id", F.array_join(F.transform(j, lambda x: x["meaningful"].cast("string")), ",").alias("meaningful"), j[0]["answered"].alias("answered"))


@query("numbered_actions", """WITH t AS (SELECT turn, conv_id, CASE turn % 5 WHEN 0 THEN 'forward ' || conv_id WHEN 1 THEN 'turn left ' || conv_id WHEN 2 THEN 'turn right' WHEN 3 THEN 'Stop now' ELSE '?' END AS s FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS action,
  CAST(CASE turn % 5 WHEN 3 THEN 1 WHEN 0 THEN greatest(1, least(3, conv_id // 25)) WHEN 1 THEN greatest(1, least(3, conv_id // 30)) ELSE 1 END AS INTEGER) AS queued FROM t""")  # fmt: skip
def numbered_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("turn") % 5, F.col("conv_id").cast("string")
    t = F.when(k == 0, F.concat(F.lit("forward "), c)).when(k == 1, F.concat(F.lit("turn left "), c)).when(k == 2, "turn right").when(k == 3, "Stop now").otherwise("?")
    p = text.numbered_action(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", p["action"].alias("action"), F.size(text.queued_actions(p, F.lit(1))).alias("queued"))


@query("model_commands", """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value / 100 WHEN 1 THEN 0.3 WHEN 2 THEN -0.5 ELSE 0 END, 6) AS vx,
  CASE event_id % 4 WHEN 0 THEN 'velocity' WHEN 1 THEN 'text' WHEN 2 THEN 'trajectory' ELSE 'error' END AS parsed_from, event_id % 4 = 3 AS stop FROM events""")  # fmt: skip
def model_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    answer = F.when(k == 0, F.concat(F.lit('{"vx": '), (F.col("value") / 100).cast("string"), F.lit("}"))).when(k == 1, '{"result": "go straight on"}').when(k == 2, '{"trajectory": [[0, 0], [1, 0], [2, 0]]}')
    c = adapters.command(answer, F.lit("any"), F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(c["vx"], 6).alias("vx"), c["parsed_from"].alias("parsed_from"), c["stop"].alias("stop"))


@query("task_success", f"""WITH {STEPS}, e AS (SELECT *, CASE episode_id % 5 WHEN 0 THEN 'vln' WHEN 1 THEN 'objectnav' WHEN 2 THEN 'pointnav' WHEN 3 THEN 'imgnav' ELSE 'nogoalnav' END AS task, x / 100 AS d FROM steps)
SELECT episode_id, seq, CASE task WHEN 'objectnav' THEN d <= 1 WHEN 'pointnav' THEN d < 0.2 WHEN 'imgnav' THEN d <= 1 AND y > 80 WHEN 'nogoalnav' THEN NOT collided AND (y >= 80 OR y / 100 >= 0.25) ELSE d < 0.5 END AS reached FROM e""")  # fmt: skip
def task_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    task = F.get(F.array(*(F.lit(t) for t in ("vln", "objectnav", "pointnav", "imgnav", "nogoalnav"))), (F.col("episode_id") % 5).cast("int"))
    return s.select("episode_id", "seq", episodes.reached(task, F.col("x") / 100, F.col("y") / 100, F.col("collided"), F.col("y"), F.col("y") / 100).alias("reached"))


@query("target_objects", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'projection_screen' WHEN 2 THEN 'unknown' ELSE 'window' END AS target FROM part""")
def target_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*(F.lit(t) for t in ("To the Chair", "the projection wall", "the shelf", "cup near the window"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", episodes.target_object(said).alias("target"))


@query("task_types", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'nogoalnav' WHEN 1 THEN 'vln' WHEN 2 THEN 'objectnav' WHEN 3 THEN 'pointnav' ELSE 'vln' END AS task FROM part")
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    has = {"instruction_type": F.when(k == 0, "Goal-less"), "instructions": F.when(k <= 1, "x"), "target_object": F.when(k == 2, "chair"), "goal_position": F.when(k == 3, F.array(F.lit(0.0)))}
    return table(spark, sf_dir, "part").select("p_partkey", episodes.task_type(has).alias("task"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as samples: their turns are instructions, their lengths points."""
    c = table(spark, sf_dir, "conversations")
    point = F.struct(F.array(F.length("text").cast("double"), F.col("turn").cast("double"), F.lit(0.5)).alias("position"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("rotation"))
    raw = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.lit("Area-based").alias("instruction_type"), F.lit("a_1").alias("start"), F.lit("b_2").alias("end"), F.col("text").alias("generated_instruction")))).otherwise(F.concat(F.lit("go "), F.col("turn").cast("string")))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", raw.alias("raw"), point.alias("p")))).alias("t"))
    return rows.select(F.lit("s").alias("scene_id"), F.lit("s").alias("scene_name"), F.col("conv_id").cast("string").alias("trajectory_id"), F.transform("t", lambda x: x["raw"]).alias("instructions"), F.transform("t", lambda x: x["p"]).alias("points"))


@query("episodes", """WITH l AS (SELECT conv_id, CAST(arg_max(length(text), turn) AS DOUBLE) AS gx FROM conversations GROUP BY conv_id)
SELECT conv_id || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS episode_id, CASE WHEN turn % 2 = 0 THEN text ELSE 'go ' || turn END AS instruction, CASE WHEN turn % 2 = 0 THEN 'b_2' END AS end_item, gx FROM conversations JOIN l USING (conv_id)""".replace("conv_id || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1", "conv_id || '-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)"))
def adapted_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes.adapted(samples(spark, sf_dir))
    return e.select("episode_id", F.col("instruction.instruction_text").alias("instruction"), "end_item", F.col("goals")[0]["position"][0].alias("gx"))


@query("unfinished_episodes", "SELECT doc_id AS episode_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)")
def unfinished_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"))
    return episodes.unfinished(d, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "episode_id"), ["quality", "toxic"])


@query("scene_poses", """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 20 AS a FROM events),
w AS (SELECT *, atan2(2 * cos(a / 2) * sin(a / 2), 1 - 2 * sin(a / 2) ** 2) + pi() AS y0 FROM s), v AS (SELECT *, CASE WHEN y0 > pi() THEN y0 - 2 * pi() ELSE y0 END AS y FROM w)
SELECT user_id, CAST(i AS INTEGER) AS i, round(-(500 - x), 6) AS x, round(CASE WHEN i = n - 1 THEN 0 ELSE -sin(y / 2) END, 6) AS qx, round(CASE WHEN i = n - 1 THEN 1 ELSE cos(y / 2) END, 6) AS qw FROM v""")  # fmt: skip
def scene_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("a", F.get_json_object("props", "$.k").cast("double") / 20)
    p = F.struct("ts", "event_id", F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("a") / 2).alias("qz"), F.cos(F.col("a") / 2).alias("qw"))
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(p)).alias("p"))
    poses = rows.select("user_id", F.posexplode(geometry.scene_poses(F.col("p"), F.lit(0.0), F.lit(500.0), F.lit(0.0), F.lit(500.0))).alias("i", "q"))
    return poses.select("user_id", "i", *(F.round(f"q.{c}", 6).alias(c) for c in ("x", "qx", "qw")))


@query("document_round_trip", "SELECT conv_id || '' AS trajectory_id, count(*) AS n_instructions, CAST(sum(length(text)) AS DOUBLE) AS x FROM conversations GROUP BY conv_id")
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as JSON documents and back, without files."""
    s = samples(spark, sf_dir).withColumn("pos", F.col("trajectory_id").cast("long"))
    doc = writers.trajectory_documents(s)
    schema = "struct<scenes:array<struct<scene_id:string,scene_name:string,samples:array<struct<trajectory_id:string,instructions:array<string>,points:array<struct<position:array<double>>>>>>>>"
    back = doc.select(F.explode(F.from_json("value", schema)["scenes"][0]["samples"]).alias("x"))
    total = F.aggregate("x.points", F.lit(0.0), lambda a, p: a + p["position"][0])
    return back.select("x.trajectory_id", F.size("x.instructions").cast("long").alias("n_instructions"), total.alias("x"))


@query("renamed_files", "SELECT 'test_' || regexp_replace(source || '.json', '^(train|val|test|trajectories_overall)_', '') AS file, 1.0::DOUBLE AS share FROM (SELECT DISTINCT source FROM documents)")
def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".json")).alias("file")).distinct()
    f = f.select(writers.renamed(F.col("file"), "test").alias("file"))
    return f.join(F.broadcast(writers.renamed_share(f, "test")))  # one row


@query("numbered_stems", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def numbered_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise("x"), F.col("doc_id").cast("string"), F.lit(".usdz")).alias("file"))
    return readers.numbered_files(f).select("doc_id")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return online.windowed(e, "ts", "10 minutes", "1 hour", by=("event_type",)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return online.sessions(e, "ts", "10 minutes", "6 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
