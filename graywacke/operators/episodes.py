"""Episodes of a fixed length and three ways to answer them: observe, always, or at random.

An episode begins with an event that no episode covers and covers what follows within its window, which later events don't prolong: the
window of 180 seconds is the same for answered and unanswered episodes, so that their counts can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from graywacke.operators import logs

WINDOW_SECONDS = 180
MODES = ("observe", "always", "randomised")
EPISODE = StructType([StructField("started_us", LongType()), StructField("n_events", LongType())])


class Run:
    """Episodes of one key, from times in order."""

    def __init__(self, window_us: int, started: int | None = None, n: int = 0):
        self.window_us, self.started, self.n, self.done = window_us, started, n, []

    def see(self, t: int) -> None:
        if self.started is None or t >= self.started + self.window_us:
            self.close()
            self.started, self.n = t, 0
        self.n += 1

    def close(self) -> None:
        if self.started is not None:
            self.done.append((self.started, self.n))
            self.started = None


def answered(found: DataFrame, mode: str, seed: int) -> DataFrame:
    """found (key, started_us, ...) with started, draw, arm and played: never, always, or where the draw of seed, key and start says "treated"."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    drawn = logs.randomised(found, seed, "key", "started_us")
    arm = F.col("arm") if mode == "randomised" else F.lit("treated" if mode == "always" else "control")
    return drawn.select("key", F.timestamp_micros("started_us").alias("started"), "n_events", "draw", arm.alias("arm"), (arm == "treated").alias("played"))


def episodes(events: DataFrame, key: str, ts: str, mode: str, seed: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, started, n_events, draw, arm, played) of a table of events. Rows without a key or time are left out.

    A gap as long as the window parts a key's events for good, whatever came before: the runs between such gaps are what goes to a kernel, as
    arrays of times.
    """
    window_us = seconds * 1_000_000
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).dropna()
    order = Window.partitionBy("key").orderBy("us")
    begins = rows.withColumn("begins", F.when(F.col("us") - F.lag("us").over(order) < window_us, 0).otherwise(1))
    runs = begins.withColumn("run", F.sum("begins").over(order)).groupBy("key", "run").agg(F.array_sort(F.collect_list("us")).alias("times"))

    @F.pandas_udf(ArrayType(EPISODE))
    def cut(times: pd.Series) -> pd.Series:
        out = []
        for each in times:
            r = Run(window_us)
            for t in each:
                r.see(int(t))
            r.close()
            out.append([{"started_us": s, "n_events": n} for s, n in r.done])
        return pd.Series(out)

    return answered(runs.select("key", F.explode(cut("times")).alias("e")).select("key", "e.*"), mode, seed)


def stream_episodes(events: DataFrame, key: str, ts: str, ids: list[str], mode: str, seed: int, seconds: int = WINDOW_SECONDS, late_seconds: int = 60) -> DataFrame:
    """The same of a stream: an episode is given out once the watermark has passed its end.

    Rows of equal ids within the watermark count once; rows that come later than late_seconds are dropped. The state of a key holds the times that
    the watermark has not reached, to be taken in order, and the open episode; a timer at the episode's end closes it where nothing follows.
    """
    kind = events.schema[key].dataType
    window_us = seconds * 1_000_000
    timed = events.filter(F.col(key).isNotNull()).withColumn("ts_", F.col(ts).cast("timestamp")).withWatermark("ts_", f"{late_seconds} seconds").dropDuplicatesWithinWatermark(ids)
    rows = timed.select(F.col(key).alias("key"), F.unix_micros("ts_").alias("us"), "ts_")

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, started, n = state.get if state.exists else ([], None, 0)
        waiting = [*map(int, waiting), *(int(t) for f in frames for t in f.us)]
        reached = state.getCurrentWatermarkMs() * 1000
        run = Run(window_us, None if started is None else int(started), int(n))
        for t in sorted(t for t in waiting if t <= reached):
            run.see(t)
        waiting = [t for t in waiting if t > reached]
        if run.started is not None and run.started + window_us <= reached:
            run.close()
        if run.started is None and not waiting:
            state.remove()
        else:
            state.update((waiting, run.started, run.n))
            due = min([*waiting, *([] if run.started is None else [run.started + window_us])])
            state.setTimeoutTimestamp(max(due // 1000 + 1, reached // 1000 + 1))
        yield pd.DataFrame([(name[0], s, k) for s, k in run.done], columns=["key", "started_us", "n_events"])

    out = StructType([StructField("key", kind), *EPISODE.fields])
    memory = StructType([StructField("waiting", ArrayType(LongType())), StructField("started", LongType()), StructField("n", LongType())])
    found = rows.groupBy("key").applyInPandasWithState(step, out, memory, "append", GroupStateTimeout.EventTimeTimeout)
    return answered(found, mode, seed)
