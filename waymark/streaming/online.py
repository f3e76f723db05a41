"""Online forms: measures folded over a stream of steps, caches, and windows of event time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after which an episode without new steps is closed.
EPISODE_LIMIT = 80

STATE = "n long, x double, y double, z double, length double, hits long, since long, recovering long, first_t double, last_t double"
OUT = "episode_id {kind}, n_samples long, path_length double, collision_count long, integrated_collision_penalty double, episode_time double, closed boolean"


def fold(state: tuple | None, steps: pd.DataFrame) -> tuple:
    """The state of an episode after further steps(seq, t, x, y, z, collided)."""
    n, x, y, z, length, hits, since, recovering, first, last = state or (0, 0.0, 0.0, 0.0, 0.0, 0, 99, 0, 0.0, 0.0)
    for s in steps.sort_values("seq").itertuples():
        length += math.dist((x, y, z), (s.x, s.y, s.z)) if n else 0.0
        first = s.t if not n else first
        since = 0 if s.collided else since + 1
        hits, recovering = hits + int(s.collided), recovering + int(since <= 2)
        n, x, y, z, last = n + 1, s.x, s.y, s.z, s.t
    return n, x, y, z, float(length), hits, since, recovering, first, last


def online_measures(steps: DataFrame, limit_ms: int = EPISODE_LIMIT * 1000) -> DataFrame:
    """Running measures of each episode of a stream of steps; an episode that is silent too long is closed.

    Steps of one episode are folded in the order of seq within a micro-batch.
    """
    kind = steps.schema["episode_id"].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s, closed = state.get, True
            state.remove()
        else:
            s, closed = fold(state.get if state.exists else None, pd.concat(list(parts))), False
            state.update(s)
            state.setTimeoutDuration(limit_ms)
        yield pd.DataFrame([(key[0], s[0], s[4], s[5], s[7] / max(1, s[0]), s[9] - s[8], closed)], columns=["episode_id", "n_samples", "path_length", "collision_count", "integrated_collision_penalty", "episode_time", "closed"])

    return steps.groupBy("episode_id").applyInPandasWithState(run, OUT.format(kind=kind), STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def new_answers(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests of a stream whose keys were not asked before, for a cache of answers; needs a watermark to forget."""
    return requests.dropDuplicatesWithinWatermark(keys)


def resumable(write: Callable[[DataFrame, int], None], done: Callable[[], DataFrame], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that leaves out rows whose keys done() has already."""

    def run(batch: DataFrame, epoch: int) -> None:
        write(batch.join(done().select(*keys).distinct(), keys, "left_anti"), epoch)

    return run


def windowed(events: DataFrame, time: str, late: str, size: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in tumbling or sliding windows of event time; rows that come later than late are dropped."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size, slide) if slide else F.window(time, size), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, late: str, gap: str, by: str) -> DataFrame:
    """Sessions of a key, ended by a gap in event time."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return grouped.agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
