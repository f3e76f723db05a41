"""Column expressions on labels, keys, JSON answers and action texts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def label_or_unknown(label: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("unknown"))


def normalised_label(label: Column) -> Column:
    return F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_"))


def tail_id(scene_key: Column) -> Column:
    """What follows the last underscore."""
    return F.substring_index(scene_key, "_", -1)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank or null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def two_decimals(v: Column) -> Column:
    """Text with two decimals, as C's printf rounds the exact binary value, which no built-in function does."""
    @F.pandas_udf("string")
    def show(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if pd.isna(a) else f"{a:.2f}")

    return show(v.cast("double"))


def bounds_text(box: Column) -> Column:
    """"(x, y, z),(x, y, z)" of a box struct, two decimals each."""
    part = lambda k: F.concat(F.lit("("), F.concat_ws(",", *(two_decimals(box[f"{a}{k}"]) for a in "xyz")), F.lit(")"))
    return F.concat(part(0), F.lit(","), part(1))


def trajectory_key(path: Column) -> dict[str, Column]:
    """prefix, scene and part of a trajectory file's name; part 1 without a suffix, null for other names."""
    pattern = r"trajectories_(\d+)_(\d+)(?:_part(\d+))?_trans\.json$"
    get = lambda k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    return {"prefix": get(1), "scene": get(2), "part": F.when(path.rlike(pattern), F.coalesce(get(3), F.lit("1")).cast("int"))}


def part_number(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"_part(\d+)", 1), F.lit("")), F.lit("1")).cast("int")


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    show = lambda v, unit: F.concat(F.format_string("%.1f", v), F.lit(unit))
    return F.when(seconds < 60, show(seconds, "s")).when(seconds < 3600, show(seconds / 60, "min")).otherwise(show(seconds / 3600, "h"))


# JSON answers of language models.  Fixed values: what may stand after an opening fence, the marked one first, and what a fence holds.
FENCES = ("json", "")
FENCED = r"(?s)```%s\s*(\{.*?\}|\[.*?\])\s*```"


def json_candidates(text: Column) -> list[Column]:
    """Parts of a chatty answer that may be its JSON, in the order in which they are tried."""
    fenced = [F.nullif(F.regexp_extract(text, FENCED % kind, 1), F.lit("")) for kind in FENCES]
    between = []
    for a, b in ("{}", "[]"):
        start, end = F.instr(text, a), F.length(text) - F.instr(F.reverse(text), b) + 1
        between.append(F.when((start > 0) & text.contains(b) & (end > start), F.substr(text, start, end - start + 1)))
    return [text, *fenced, *between]


def whole_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value; null if it is none or something follows it, which the parser itself lets pass."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    items = F.try_variant_get(listed, "$", "array<variant>")
    return F.when((F.size(items) == 1) & named.isNotNull(), F.get(items, F.lit(0)))


def robust_json(text: Column) -> Column:
    """The answer's JSON as VARIANT: the whole text, a fenced block, from { to the last }, or from [ to the last ]; else null."""
    return F.coalesce(*(whole_json(c) for c in json_candidates(text)))


def _is_list(json: Column) -> Column:
    return F.coalesce(F.schema_of_variant(json).startswith("ARRAY"), F.lit(False))


def judgements(answer: Column, n: Column) -> Column:
    """array<struct<meaningful, answered>> for n pairs: all false unless the answer is a list; missing ones false."""
    json = robust_json(answer)
    items = F.try_variant_get(json, "$", "array<variant>")

    def one(i: Column) -> Column:
        said = F.lower(F.try_variant_get(F.get(items, i), "$.meaningful", "string"))
        return F.struct(F.coalesce(said.isin("true", "yes", "1"), F.lit(False)).alias("meaningful"), F.lit(True).alias("answered"))

    none = lambda i: F.struct(F.lit(False).alias("meaningful"), F.lit(False).alias("answered"))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(_is_list(json), F.transform(index, one)).otherwise(F.transform(index, none))


INSTRUCTION = "struct<instruction_type:string,start:string,end:string,generated_instruction:string,scene_id:string>"


def default_instruction(start: Column, end: Column, scene: Column) -> Column:
    text = F.concat(F.lit("Navigate from "), start, F.lit(" to "), end, F.lit("."))
    return F.struct(F.lit("Default").alias("instruction_type"), start.alias("start"), end.alias("end"), text.alias("generated_instruction"), scene.alias("scene_id"))


def instructions(answer: Column, start: Column, end: Column, scene: Column) -> Column:
    """array of instruction structs of an answer: those of a list, one object, or else the default one."""
    json = robust_json(answer)
    kind = F.coalesce(F.schema_of_variant(json), F.lit("VOID"))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(json, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array(json))
    objects = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    get = lambda v, k: F.try_variant_get(v, f"$.{k}", "string").alias(k)
    found = F.transform(objects, lambda v: F.struct(get(v, "instruction_type"), get(v, "start"), get(v, "end"), get(v, "generated_instruction"), scene.alias("scene_id")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(default_instruction(start, end, scene)))


def has_valid(instruction_list: Column) -> Column:
    """Some instruction is not a default one and has a text."""
    return F.exists(instruction_list, lambda i: (F.lower(F.coalesce(i["instruction_type"], F.lit(""))) != "default") & (F.coalesce(i["generated_instruction"], F.lit("")) != ""))


def normalised_instruction(raw: Column) -> Column:
    """The instruction struct of a JSON object, or of a bare text."""
    json = whole_json(raw)
    is_object = F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False))
    get = lambda k: F.when(is_object, F.try_variant_get(json, f"$.{k}", "string"))
    bare = F.when(~is_object, F.coalesce(F.try_variant_get(json, "$", "string"), raw))
    return F.struct(*(get(k).alias(k) for k in ("instruction_type", "start", "end")), F.coalesce(get("generated_instruction"), bare).alias("generated_instruction"), get("scene_id").alias("scene_id"))


# Action texts.  Fixed values: the words and numbers that the answers are searched for.
STOP_WORDS = ["stop", "halt", "complete", "finish", "done"]
FORWARD_WORDS = ["forward", "ahead", "straight", "move"]
BACK_WORDS = ["back", "backward", "reverse"]
ACTIONS = ["MOVE_FORWARD", "TURN_LEFT", "TURN_RIGHT", "STOP"]
ACTION_WORDS = {"MOVE_FORWARD": ["FORWARD", "AHEAD", "MOVE", "GO"], "TURN_LEFT": ["LEFT"], "TURN_RIGHT": ["RIGHT"], "STOP": ["STOP", "HALT", "DONE", "FINISH"]}
NEXT_ACTION = {"MOVE_FORWARD": "move forward 0.35 meter", "TURN_LEFT": "turn left 30 degree", "TURN_RIGHT": "turn right 30 degree", "STOP": "stop"}


def text_command(text: Column) -> Column:
    """struct<vx, yaw_rate, duration_s, stop> of a free-text action."""
    t = F.lower(F.coalesce(text, F.lit("")))
    number = lambda unit: F.nullif(F.regexp_extract(t, r"(\d+\.?\d*)\s*(?:" + unit + ")", 1), F.lit("")).try_cast("double")
    stop = any_of(t, STOP_WORDS)
    metres = number("meter|metre|m|step")
    ahead = F.when(any_of(t, FORWARD_WORDS), F.when(metres.isNull(), 0.3).otherwise(F.least(metres, F.lit(0.5)))).otherwise(0.0)
    turn = F.radians(F.coalesce(number("degree|deg|°"), F.lit(30.0)))
    rate = F.when(t.contains("left"), turn).when(t.contains("right"), -turn).otherwise(0.0)
    return F.struct(
        F.when(stop, 0.0).when(any_of(t, BACK_WORDS), -0.2).otherwise(ahead).alias("vx"),
        F.when(stop, 0.0).otherwise(rate).alias("yaw_rate"),
        F.lit(1.0).alias("duration_s"),
        stop.alias("stop"),
    )


def answer_text(answer: Column) -> Column:
    """The text of a server's answer under any of its three names; else the answer as it is."""
    json = whole_json(answer)
    return F.coalesce(*(F.try_variant_get(json, f"$.{k}", "string") for k in ("text_response", "text", "result")), answer)


def action_of(text: Column) -> Column:
    """One of the four actions: named outright, else by a word; MOVE_FORWARD if there is none."""
    t = F.upper(F.coalesce(text, F.lit("")))
    cases = [(t.contains(a), a) for a in ACTIONS] + [(any_of(t, w), a) for a, w in ACTION_WORDS.items()]
    found = F.when(cases[0][0], cases[0][1])
    for c, a in cases[1:]:
        found = found.when(c, a)
    return found.otherwise("MOVE_FORWARD")


def numbered_action(text: Column) -> Column:
    """struct<action, value> of a text such as "turn left 30": 0 stop, 1 forward, 2 left, 3 right, null if unknown."""
    t = F.lower(F.coalesce(text, F.lit("")))
    number = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(-?\d+)", 1), F.lit("")).try_cast("double")
    action = F.when(t.contains("stop"), 0).when(t.contains("forward"), 1).when(t.contains("left"), 2).when(t.contains("right"), 3)
    value = F.when(action == 1, F.coalesce(number, F.lit(50.0))).when(action > 1, F.coalesce(number, F.lit(30.0)))
    return F.struct(action.alias("action"), value.alias("value"))


def queued_actions(parsed: Column, otherwise: Column) -> Column:
    """The steps that a numbered action stands for, three at most; otherwise, if that is none."""
    a, v = parsed["action"], parsed["value"]
    n = F.when(a == 0, 1).when(a == 1, F.least(F.lit(3), (v / 25).cast("int"))).when(a > 1, F.least(F.lit(3), (v / 30).cast("int"))).otherwise(0)
    return F.when(n > 0, F.array_repeat(a, F.greatest(n, F.lit(0)))).otherwise(F.array(otherwise))


def action_velocity(action: Column) -> Column:
    """struct<vx, yaw_rate, duration_s, stop> of a numbered action."""
    turn = math.radians(30)
    return F.struct(
        F.when(action == 1, 0.25).otherwise(0.0).alias("vx"),
        F.when(action == 2, turn).when(action == 3, -turn).otherwise(0.0).alias("yaw_rate"),
        F.when(action.isin(1, 2, 3), 1.0).otherwise(0.0).alias("duration_s"),
        F.coalesce(~action.isin(1, 2, 3), F.lit(True)).alias("stop"),
    )


def trajectory_command(points: Column, angle: Column) -> Column:
    """struct<vx, vy, yaw_rate> of predicted points array<struct<x, y>>: toward the first one over 1 cm away, at 0.5 m/s at most."""
    n = F.size(points)
    legs = F.zip_with(F.slice(points, 1, F.least(F.lit(5), F.greatest(n - 1, F.lit(0)))), F.slice(points, 2, F.least(F.lit(5), F.greatest(n - 1, F.lit(0)))), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    heads = F.transform(F.filter(legs, lambda d: F.hypot(d["dx"], d["dy"]) > 0.005), lambda d: F.atan2(d["dy"], d["dx"]))
    from .geometry import body_to_world, normalised

    k = F.size(heads)
    turns = F.zip_with(F.slice(heads, 1, F.greatest(k - 1, F.lit(0))), F.slice(heads, 2, F.greatest(k - 1, F.lit(0))), lambda a, b: normalised(b - a))
    mean = F.try_divide(F.aggregate(turns, F.lit(0.0), lambda s, v: s + v), F.size(turns).cast("double"))
    most = math.radians(60)
    rate = F.when((n >= 3) & (k >= 2), F.greatest(F.lit(-most), F.least(F.lit(most), mean * 2))).otherwise(0.0)
    far = F.get(F.filter(points, lambda p: F.hypot(p["x"], p["y"]) > 0.01), F.lit(0))
    vx, vy = body_to_world(-far["x"] * 3, far["y"] * 3, angle)
    cut = F.least(F.lit(1.0), F.try_divide(F.lit(0.5), F.hypot(vx, vy)))
    return F.struct(F.coalesce(vx * cut, F.lit(0.0)).alias("vx"), F.coalesce(vy * cut, F.lit(0.0)).alias("vy"), rate.alias("yaw_rate"))


def next_action_text(action: Column) -> Column:
    """The sentence that names the next action; unknown ones in lower case."""
    names = F.create_map(*(F.lit(x) for kv in NEXT_ACTION.items() for x in kv))
    return F.concat(F.lit("The next action is "), F.coalesce(F.try_element_at(names, action), F.lower(action)), F.lit("."))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its placeholders replaced."""
    for k, v in values.items():
        template = F.replace(template, F.lit(k), v)
    return template


def checked_template(template: Column, placeholder: str, n: int) -> Column:
    """The template; fails unless it holds the placeholder n times."""
    count = F.try_divide(F.length(template) - F.length(F.replace(template, F.lit(placeholder), F.lit(""))), F.lit(len(placeholder)))
    return F.when(F.assert_true(count == n, f"the template must hold {placeholder} {n} times").isNull(), template)


def frame_path(scene: Column, trajectory: Column, frame: Column) -> Column:
    return F.concat(scene, F.lit("/images/trajectory_"), trajectory, F.lit("/"), frame)
