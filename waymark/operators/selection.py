"""Orders, limits, quotas, samples, parts, set operations and dataset splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def shuffled_order(*keys: str, seed: int = 42) -> Column:
    """A stable random order."""
    return F.xxhash64(*keys, F.lit(seed))


def first_scenes(scenes: DataFrame, n: int | None, only: list[str] | None = None) -> DataFrame:
    """Scenes by id, some of them by name, the first n."""
    rows = scenes if only is None else scenes.where(F.col("scene_id").isin(only))
    rows = rows.orderBy("scene_id")
    return rows if n is None else rows.limit(n)


def midsize(scenes: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """k of scenes(scene_id, pairs): drawn from the 2k that follow the smallest quarter by pairs; all if there are no more than k."""
    n = scenes.count()
    if n <= k:
        return scenes
    ranked = scenes.orderBy("pairs", "scene_id").limit(n // 4 + 2 * k)
    placed = ranked.withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pairs", "scene_id")) - 1).where(F.col("__i") >= n // 4).drop("__i")
    return placed.orderBy(shuffled_order("scene_id") if order is None else order, "scene_id").limit(k)


def proportional(home: int, non_home: int, target: int) -> tuple[int, int]:
    """How many scenes of either kind make up the target: by share, one of each at least, no more than there are."""
    total = home + non_home
    a = max(1, int(target * (home / total if total else 0)))
    return min(a, home), min(max(1, target - a), non_home)


def balanced_scenes(scenes: DataFrame, target: int, order: Column | None = None) -> DataFrame:
    """target of scenes(scene_id, pairs, scene_type), balanced between home and others, topped up from the rest."""
    counts = {r.scene_type: r["count"] for r in scenes.groupBy("scene_type").count().collect()}  # two kinds
    a, b = proportional(counts.get("home", 0), counts.get("non_home", 0), target)
    picked = midsize(scenes.where("scene_type = 'home'"), a, order).unionByName(midsize(scenes.where("scene_type = 'non_home'"), b, order))
    if a + b >= target:
        return picked
    rest = scenes.join(picked.select("scene_id"), "scene_id", "left_anti")
    return picked.unionByName(rest.orderBy(shuffled_order("scene_id") if order is None else order, "scene_id").limit(target - a - b))


def greedy_quota(rows: DataFrame, count: str, target: Column | int, by: list[str], order: list) -> DataFrame:
    """Rows in order while the sum before them is under the target; the last one may overshoot."""
    before = F.sum(count).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__b", F.coalesce(before, F.lit(0))).where(F.col("__b") < target).drop("__b")


def capped_quota(rows: DataFrame, count: str, target: Column | int, by: list[str], order: list) -> DataFrame:
    """rows with taken: a third and one of each row's count, in order, until the target is met."""
    want = F.floor(F.col(count) / 3) + 1
    before = F.sum("__w").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__w", F.least(want, F.col(count))).withColumn("__b", F.coalesce(before, F.lit(0)))
    taken = F.greatest(F.lit(0), F.least(F.col("__w"), F.lit(target) - F.col("__b")))
    return rows.withColumn("taken", taken.cast("long")).where("taken > 0").drop("__w", "__b")


def trajectory_pool(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """A third of each scene's trajectories, in a random order, one at least."""
    w = Window.partitionBy("scene_id").orderBy(shuffled_order("scene_id", "trajectory_id") if order is None else order, "trajectory_id")
    placed = rows.withColumns({"place": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy("scene_id"))})
    return placed.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 3))).drop("__n")


def scene_targets(scenes: Column, target: int) -> Column:
    """array<struct<scene_id, quota>> of scenes array<struct<scene_id, counts array<long>>>, one after the other.

    A scene's quota is an even part of the target, or what is left of it; what a
    scene takes, the last trajectory's overshoot included, counts against those after it.
    """
    share = F.floor(F.lit(target) / F.size(scenes))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<scene_id:string,quota:bigint>>").alias("out"))

    def take(counts: Column, quota: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: F.when(a < quota, a + c).otherwise(a))

    def step(state: Column, s: Column) -> Column:
        left = F.lit(target) - state["used"]
        quota = F.least(left, share).cast("long")
        go = F.struct((state["used"] + take(s["counts"], quota)).alias("used"), F.concat(state["out"], F.array(F.struct(s["scene_id"].alias("scene_id"), quota.alias("quota")))).alias("out"))
        return F.when(left > 0, go).otherwise(state)

    return F.aggregate(scenes, start, step, lambda s: s["out"])


def unseen_trajectories(trajectories: DataFrame, target: int, n_scenes: int, order: Column | None = None) -> DataFrame:
    """Test trajectories of trajectories(scene_id, trajectory_id, instruction_count) from n_scenes scenes, of about target instructions.

    Quotas are worked out over the few scenes drawn; trajectories follow by running sums.
    """
    scenes = trajectories.select("scene_id").distinct().orderBy(F.xxhash64("scene_id", F.lit(7)) if order is None else F.col("scene_id"), "scene_id").limit(n_scenes)
    pool = trajectory_pool(trajectories.join(F.broadcast(scenes), "scene_id"), order)
    counts = pool.groupBy("scene_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "instruction_count"))), lambda x: x["instruction_count"]).alias("counts"))
    lead = F.xxhash64("scene_id", F.lit(7)) if order is None else F.lit(0)
    rows = counts.agg(F.transform(F.sort_array(F.collect_list(F.struct(lead.alias("o"), F.col("scene_id").cast("string").alias("scene_id"), "counts"))), lambda x: F.struct(x["scene_id"].alias("scene_id"), x["counts"].alias("counts"))).alias("s"))
    quotas = rows.select(F.explode(scene_targets(F.col("s"), target)).alias("q")).select("q.*")
    joined = pool.withColumn("__k", F.col("scene_id").cast("string")).join(F.broadcast(quotas.withColumnRenamed("scene_id", "__k")), "__k").drop("__k")
    return greedy_quota(joined, "instruction_count", F.col("quota"), ["scene_id"], ["place"]).drop("quota", "place")


def parts_of(rows: DataFrame, size: int, order: list) -> DataFrame:
    """rows with part and place: parts of exactly size rows, but for the last, in order.

    Rows are ranked within ranges of the order and the ranges' counts summed, so
    no task holds all rows.  The ranged rows are written once, as ranges drawn
    twice would have different bounds.  Rows that are equal in order have their
    places in no order of their own.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "ranges")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__m").alias("__first"))  # one row for each partition
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # numbers within a partition have no gaps
    placed = ranged.join(F.broadcast(before.select("__p", "__b", "__first")), "__p").withColumn("place", F.col("__b") + F.col("__m") - F.col("__first"))
    return placed.withColumn("part", F.floor(F.col("place") / size)).drop("__p", "__m", "__b", "__first")


def chunks(rows: DataFrame, size: int, by: list[str], order: list, value: str) -> DataFrame:
    """(by..., chunk, values): lists of size values in order."""
    placed = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    grouped = placed.groupBy(*by, F.floor(F.col("__i") / size).alias("chunk"))
    return grouped.agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def sliced(rows: DataFrame, order: list, most: int | None = None, start: int = 0, n: int | None = None) -> DataFrame:
    """The first most rows in order, of them from start on, of them n."""
    end = min(x for x in (most, None if n is None else start + n) if x is not None) if most is not None or n is not None else None
    kept = rows.orderBy(*order)
    kept = kept.limit(end) if end is not None else kept
    return kept.offset(start) if start else kept


def sharded(rows: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """The k-th of n shards."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)


def merged_parts(samples: DataFrame) -> DataFrame:
    """samples(scene_id, part, pos, ...) of all parts with a new trajectory_id, from 0 on by part and place."""
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.coalesce("part", F.lit(1)), "pos")) - 1
    return samples.withColumn("trajectory_id", place.cast("string"))


def complement(n: Column, taken: Column) -> Column:
    """The indices under n that are not taken."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), taken)).otherwise(F.array().cast("array<int>"))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__i = 1").drop("__i")


def splits(scenes: DataFrame, trajectories: DataFrame, val: int, unseen: int, target: int, n_scenes: int) -> dict[str, DataFrame]:
    """Leak-free splits of scenes(scene_id, pairs, scene_type) and trajectories(scene_id, trajectory_id, instruction_count).

    val and scene_unseen hold whole scenes; of the other scenes some give
    trajectories, others instructions to test sets, and train has the rest.
    """
    scene_unseen = balanced_scenes(scenes, unseen).select("scene_id")
    left = scenes.join(scene_unseen, "scene_id", "left_anti")
    held = balanced_scenes(left, val).select("scene_id")
    scene_unseen, held = written(scene_unseen, "unseen", few=True), written(held, "held", few=True)  # read by every split
    train = trajectories.join(scene_unseen, "scene_id", "left_anti").join(held, "scene_id", "left_anti")
    by_trajectory = written(unseen_trajectories(train, target, n_scenes), "by_trajectory", few=True)
    other = train.join(by_trajectory.select("scene_id").distinct(), "scene_id", "left_anti")
    some = other.select("scene_id").distinct().orderBy(F.xxhash64("scene_id", F.lit(8)), "scene_id").limit(n_scenes)
    quota = max(1, target // max(1, n_scenes))
    by_instruction = capped_quota(other.join(F.broadcast(some), "scene_id"), "instruction_count", quota, ["scene_id"], [shuffled_order("scene_id", "trajectory_id"), "trajectory_id"])
    keys = ["scene_id", "trajectory_id"]
    rest = train.join(by_trajectory.select(*keys), keys, "left_anti").join(by_instruction.select(*keys, "taken"), keys, "left")
    rest = rest.withColumn("instruction_count", F.col("instruction_count") - F.coalesce("taken", F.lit(0))).drop("taken")
    return {"scene_unseen": scene_unseen, "val": held, "trajectory_unseen": by_trajectory, "instruction_unseen": by_instruction, "train": rest}
