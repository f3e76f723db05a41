"""Statistics of trajectories and scenes, and their roll-ups.

trajectories(scene_id, trajectory_id, pos, n_points); instructions(scene_id,
trajectory_id, instruction_index, instruction_type, start, end, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count

#: Thresholds without any trajectory.
SHORT, LONG = 10, 50


def given(c: str) -> Column:
    """The column, null if empty."""
    return F.nullif(F.col(c), F.lit(""))


def counter(values: Column) -> Column:
    """map<string, long> of how often each value occurs in an array; null if there is none."""
    names = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(names, F.transform(names, lambda v: F.size(F.filter(values, lambda x: x == v)).cast("long")))


def trajectory_info(trajectories: DataFrame, instructions: DataFrame) -> DataFrame:
    """One row a trajectory: points, instructions, words, type counts, start-end pairs, starts and ends; empty fields do not count."""
    words = F.when(given("text").isNotNull(), word_count(F.col("text")))
    each = instructions.select("scene_id", "trajectory_id", words.alias("words"), F.struct(given("instruction_type").alias("type"), given("start").alias("start"), given("end").alias("end")).alias("item"))
    # one list, from which all others follow, is one buffer for each trajectory
    per = each.groupBy("scene_id", "trajectory_id").agg(
        F.count("*").alias("total_instructions"), F.sum(F.coalesce("words", F.lit(0))).alias("total_words"), F.avg("words").alias("avg_words"), F.collect_list("item").alias("items"),
    )
    some = lambda f: F.array_compact(F.transform("items", f))
    pair = lambda x: F.when(x["start"].isNotNull() & x["end"].isNotNull(), F.concat(x["start"], F.lit(" -> "), x["end"]))
    lists = {"pairs": pair, "starts": lambda x: x["start"], "ends": lambda x: x["end"]}
    per = per.withColumns({name: F.sort_array(F.array_distinct(some(f))) for name, f in lists.items()} | {"type_counts": counter(F.sort_array(some(lambda x: x["type"])))})
    out = trajectories.join(per.drop("items"), ["scene_id", "trajectory_id"], "left")
    return out.fillna(0, ["total_instructions", "total_words", "avg_words"])


def tercile_thresholds(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., short, long): the values at places n // 3 and 2n // 3; least and greatest of fewer than three."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    placed = rows.withColumns({"__i": F.row_number().over(w.orderBy(value)) - 1, "__n": F.count("*").over(w)})
    at = lambda k: F.max(F.when(F.col("__i") == F.floor(F.col("__n") * k / 3), F.col(value)))
    few = F.max("__n") < 3
    found = placed.groupBy(*by).agg(F.when(few, F.min(value)).otherwise(at(1)).alias("short"), F.when(few, F.max(value)).otherwise(at(2)).alias("long"))
    return found.withColumns({"short": F.coalesce("short", F.lit(SHORT)), "long": F.coalesce("long", F.lit(LONG))})


def global_terciles(rows: DataFrame, value: str) -> DataFrame:
    """tercile_thresholds() over all rows, by counts of values, so that no task sorts the rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c"))
    # one row for each distinct value
    upto = counts.withColumns({"__e": F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy(value)), "__n": F.sum("__c").over(Window.partitionBy(F.lit(0)))})
    at = lambda k: F.min(F.when(F.col("__e") > F.floor(F.col("__n") * k / 3), F.col(value)))
    few = F.max("__n") < 3
    found = upto.agg(F.when(few, F.min(value)).otherwise(at(1)).alias("short"), F.when(few, F.max(value)).otherwise(at(2)).alias("long"))
    return found.withColumns({"short": F.coalesce("short", F.lit(SHORT)), "long": F.coalesce("long", F.lit(LONG))})


def length_category(value: Column, short: Column, long: Column) -> Column:
    return F.when(value <= short, "short").when(value <= long, "middle").otherwise("long")


def length_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, avg, min, max, median, std): median of the middle two, sample deviation, 0 for one row."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("avg_length"), F.min(value).alias("min_length"), F.max(value).alias("max_length"),
        F.median(value).alias("median_length"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_length"),
    )


def histogram(rows: DataFrame, category: str, by: list[str], names: list[str] | None = None) -> DataFrame:
    """(by..., one count column a category)."""
    names = names or ["short", "middle", "long"]
    return rows.groupBy(*by).agg(*(F.count_if(F.col(category) == n).alias(n) for n in names))


def instruction_stats(info: DataFrame, by: list[str]) -> DataFrame:
    """Over trajectory_info(): mean and total instructions, mean words an instruction, total words."""
    return info.groupBy(*by).agg(
        F.avg("total_instructions").alias("avg_instructions"), F.sum("total_instructions").alias("total_instructions"),
        F.coalesce(F.try_divide(F.sum("total_words"), F.sum("total_instructions")), F.lit(0.0)).alias("avg_words"), F.sum("total_words").alias("total_words"),
    )


def location_stats(instructions: DataFrame, by: list[str]) -> DataFrame:
    """Distinct starts, ends and pairs."""
    return instructions.groupBy(*by).agg(
        F.count_distinct(given("start")).alias("unique_starts"), F.count_distinct(given("end")).alias("unique_ends"),
        F.count_distinct(F.when(given("start").isNotNull() & given("end").isNotNull(), F.struct("start", "end"))).alias("unique_pairs"),
    )


def top_counts(rows: DataFrame, value: list[str], by: list[str], k: int | None, order: str) -> DataFrame:
    """(by..., value..., n, place): the k most frequent values; of equal ones the first by order."""
    counts = rows.groupBy(*by, *value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), "__first", *value)
    if not by and k is not None:
        found = counts.orderBy(F.desc("n"), "__first", *value).limit(k)
        return found.withColumn("place", F.row_number().over(w)).drop("__first")
    placed = counts.withColumn("place", F.row_number().over(w)).drop("__first")
    return placed if k is None else placed.where(F.col("place") <= k)


def global_pairs(rows: DataFrame, value: list[str], scene: str, compat: bool = False, k: int = 10, order: str = "pos") -> DataFrame:
    """(value..., n): exact counts; compat sums only each scene's k most frequent ones."""
    if not compat:
        return rows.groupBy(*value).agg(F.count("*").alias("n"))
    return top_counts(rows, value, [scene], k, order).groupBy(*value).agg(F.sum("n").alias("n"))


def split_statistics(selected: DataFrame) -> DataFrame:
    """(split, measure, name, instructions, trajectories) of selected(split, scene_id, trajectory_id, instruction_count,
    length_category, scene_type, design_type): distributions in instructions and in trajectories."""
    out = None
    for measure in ("length_category", "scene_type", "design_type"):
        one = selected.groupBy("split", F.lit(measure).alias("measure"), F.col(measure).alias("name")).agg(F.sum("instruction_count").alias("instructions"), F.count("*").alias("trajectories"))
        out = one if out is None else out.unionByName(one)
    return out


def scaled_types(selected: DataFrame) -> DataFrame:
    """(split, name, n) of selected(split, instruction_count, types map<string, long>): type counts scaled to what was taken of each trajectory."""
    total = F.aggregate(F.map_values("types"), F.lit(0).cast("long"), lambda a, v: a + v)
    each = selected.withColumn("__t", total).select("split", "instruction_count", "__t", F.explode("types").alias("name", "c"))
    return each.groupBy("split", "name").agg(F.sum(F.coalesce(F.try_divide(F.col("c") * F.col("instruction_count"), F.col("__t")), F.lit(0.0)).cast("long")).alias("n"))


def type_shares(scenes: DataFrame) -> DataFrame:
    """(split, home_percent, non_home_percent) of scenes(split, scene_type)."""
    share = lambda t: F.avg((F.col("scene_type") == t).cast("double")) * 100
    return scenes.groupBy("split").agg(share("home").alias("home_percent"), share("non_home").alias("non_home_percent"))


def path_distance(points: DataFrame, by: str) -> DataFrame:
    """(by, total_distance) of points(by, seq, x, y, z)."""
    w = Window.partitionBy(by).orderBy("seq")
    leg = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in "xyz"), F.lit(0.0)))
    return points.withColumn("__leg", leg).groupBy(by).agg(F.coalesce(F.sum("__leg"), F.lit(0.0)).alias("total_distance"))


def map_bounds(masks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x0, x1, y0, y1) of masks(by..., coords array<array<string>>) with [y, x] texts; those that are no numbers are skipped."""
    c = masks.select(*by, F.explode("coords").alias("c"))
    y, x = (F.get("c", F.lit(k)).try_cast("double") for k in (0, 1))
    c = c.select(*by, x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    return c.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def numbered_labels(rows: DataFrame, label: Column, by: list[str], order: list[str]) -> DataFrame:
    """rows with item_id: the label and its count so far."""
    w = Window.partitionBy(*by, label).orderBy(*order)
    return rows.withColumn("item_id", F.concat_ws("_", label, F.row_number().over(w).cast("string")))


def class_ids(rows: DataFrame, label: str, order: str, predefined: list[str]) -> DataFrame:
    """(label, class_id): predefined labels from 1 on; others after a gap of none, in the order in which they are first seen."""
    known = F.create_map(*(F.lit(x) for k, n in enumerate(predefined, 1) for x in (n, k)))
    seen = rows.groupBy(F.col(label).alias("label")).agg(F.min(order).alias("__first")).withColumn("__known", F.try_element_at(known, F.col("label")))
    new = F.row_number().over(Window.partitionBy(F.col("__known").isNull()).orderBy("__first", "label")) + len(predefined)
    return seen.select("label", F.coalesce("__known", new).alias("class_id"))


def expected_sequences(samples: DataFrame) -> DataFrame:
    """(scene_id, expected) of samples(scene_id, trajectory_id, pos, n_instructions), counting each id's first sample only."""
    first = samples.groupBy("scene_id", "trajectory_id").agg(F.min_by("n_instructions", "pos").alias("n"))
    return first.groupBy("scene_id").agg(F.sum("n").alias("expected"))
