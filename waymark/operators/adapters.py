"""Calls of language and vision models behind an injected client.

A client factory returns an object with ``chat(messages) -> str``.  It is called
once in each Python worker's partition, so connections are made there.  The
fake client answers by rule, without a network.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text

#: Pairs in one request, retries, longest pause in seconds.
PAIRS_A_CALL, RETRIES, LONGEST_PAUSE = 10, 5, 16
#: Seconds that instructions are waited for before the rest gets the default one; rows after which results are kept.
LIMIT, KEPT_EVERY = 180, 5


def _drawn(of: str, n: int) -> int:
    return int(hashlib.md5(of.encode()).hexdigest()[:8], 16) % n


class FakeClient:
    """Answers judgement requests (a list of pairs) and instruction requests by a hash of what is asked."""

    def chat(self, messages: list[dict]) -> str:
        asked = messages[-1]["content"]
        try:
            pairs = json.loads(asked)
        except ValueError:
            return f"I see: {asked}"
        if isinstance(pairs, list):
            return "Here it is:\n```json\n" + json.dumps([{"start": s, "end": e, "meaningful": ["yes", False][_drawn(f"{s}|{e}", 2)]} for s, e in pairs]) + "\n```"
        one = {"instruction_type": "Add_Object", "start": pairs["start"], "end": pairs["end"], "generated_instruction": f"Go from {pairs['start']} to {pairs['end']}."}
        return json.dumps([one]) if _drawn(pairs["start"], 3) else "no idea"


def asked(rows: DataFrame, factory: Callable[[], object], messages: str = "messages", retries: int = RETRIES, pause: float = 1.0, limit: float | None = None) -> DataFrame:
    """rows with answer, the client's reply to the JSON of messages; null if it fails each time.

    Waits pause * 2**k seconds after the k-th failure, LONGEST_PAUSE at most.
    limit: seconds (LIMIT, if it is to be that of the instructions) after which a
    task asks no more; what is left has no answer and so gets the default.
    """
    at = rows.columns.index(messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, began = factory(), time.monotonic()

        def call(asked_json: str | None) -> str | None:
            if asked_json is None:
                return None
            for k in range(retries + 1):
                if limit is not None and time.monotonic() - began >= limit:
                    return None
                try:
                    return client.chat(json.loads(asked_json))
                except Exception:
                    if k < retries:
                        time.sleep(min(pause * 2**k, LONGEST_PAUSE))
            return None

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([call(x) for x in batch.column(at).to_pylist()], pa.string())], names=[*batch.schema.names, "answer"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def judged(pairs: DataFrame, factory: Callable[[], object], prompt: str, scene_text: DataFrame | None = None, size: int = PAIRS_A_CALL, **how) -> DataFrame:
    """pairs(scene_id, start, end) with meaningful and answered, asked in groups of size pairs of a scene."""
    from .selection import chunks

    rows = pairs.select("scene_id", F.struct("start", "end").alias("pair"))
    grouped = chunks(rows, size, ["scene_id"], ["pair"], "pair")
    if scene_text is not None:
        grouped = grouped.join(scene_text, "scene_id", "left")
    about = F.coalesce(F.col("text"), F.lit("")) if scene_text is not None else F.lit("")
    content = F.to_json(F.transform("values", lambda p: F.array(p["start"], p["end"])))
    grouped = grouped.withColumn("messages", F.to_json(F.array(message("system", F.concat(F.lit(prompt + "\n"), about)), message("user", content))))
    got = asked(grouped.select("scene_id", "values", "messages"), factory, **how)
    found = got.withColumn("j", text.judgements(F.coalesce("answer", F.lit("")), F.size("values")))
    each = found.select("scene_id", F.explode(F.arrays_zip("values", "j")).alias("x"))
    return each.select("scene_id", "x.values.start", "x.values.end", "x.j.meaningful", "x.j.answered")


def instructed(pairs: DataFrame, factory: Callable[[], object], prompt: str, **how) -> DataFrame:
    """pairs(scene_id, start, end) with instructions, and valid if they are more than the default one."""
    content = F.to_json(F.struct("start", "end"))
    rows = pairs.withColumn("messages", F.to_json(F.array(message("system", F.lit(prompt)), message("user", content))))
    got = asked(rows, factory, **how)
    found = got.withColumn("instructions", text.instructions(F.coalesce("answer", F.lit("")), F.col("start"), F.col("end"), F.col("scene_id").cast("string")))
    return found.withColumn("valid", text.has_valid(F.col("instructions"))).drop("messages", "answer")


def cached(rows: DataFrame, keys: list[str], call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows joined with call() of their distinct keys, so that each is asked once.  Null keys are keys too."""
    got = call(rows.select(*keys).distinct())
    on = None
    right = got.withColumnsRenamed({k: f"__{k}" for k in keys})
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return rows.join(right, on, "left").drop(*(f"__{k}" for k in keys))


def position_key(x: Column, y: Column) -> Column:
    """Positions that share an answer: rounded to 0.1."""
    return F.concat_ws(",", F.format_string("%.1f", F.bround(x, 1)), F.format_string("%.1f", F.bround(y, 1)))


def until_enough(chunks: Iterator[DataFrame], call: Callable[[DataFrame], DataFrame], enough: int, path: str) -> int:
    """Appends call() of one chunk after the other to the path until it has enough rows; returns how many."""
    n = 0
    for chunk in chunks:
        done = call(chunk)
        done.write.mode("append").parquet(path)
        n = done.sparkSession.read.parquet(path).count()
        if n >= enough:
            break
    return n


def command(answer: Column, kind: Column, angle: Column) -> Column:
    """struct<vx, vy, yaw_rate, duration_s, stop, parsed_from> of a server's answer: a text, a velocity object or a list of points; stop if it is none."""
    return text.let(text.whole_json(answer), lambda json: _command(json, answer, kind, angle))


def _command(json: Column, answer: Column, kind: Column, angle: Column) -> Column:
    get = lambda k, t: F.try_variant_get(json, f"$.{k}", t)
    said = F.coalesce(get("text_response", "string"), get("text", "string"), get("result", "string"), answer)
    points = F.transform(F.try_variant_get(json, "$.trajectory", "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    t, moved = text.text_command(said), text.trajectory_command(points, angle)
    make = lambda vx, vy, rate, s, stop, name: F.struct(vx.alias("vx"), vy.alias("vy"), rate.alias("yaw_rate"), s.alias("duration_s"), stop.alias("stop"), F.lit(name).alias("parsed_from"))
    zero = F.lit(0.0)
    return (
        F.when(kind.isNull() | answer.isNull(), make(zero, zero, zero, zero, F.lit(True), "error"))
        .when(points.isNotNull(), make(moved["vx"], moved["vy"], moved["yaw_rate"], F.lit(1.0), F.lit(False), "trajectory"))
        .when(get("vx", "double").isNotNull(), make(get("vx", "double"), F.coalesce(get("vy", "double"), zero), F.coalesce(get("yaw_rate", "double"), zero), F.coalesce(get("duration_s", "double"), F.lit(1.0)), F.coalesce(get("stop", "boolean"), F.lit(False)), "velocity"))
        .otherwise(make(t["vx"], zero, t["yaw_rate"], t["duration_s"], t["stop"], "text"))
    )
