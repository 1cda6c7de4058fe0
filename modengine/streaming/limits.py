"""The stateful rules on streams, and the sink that keeps statistics.

State is a user's recent messages within the window, so it is bounded by the window, and ends when the watermark has
passed the last of them by one. Messages of a user are taken in order of (ts, msg_id) within a micro-batch; those later
than the watermark's delay are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modengine.operators.limits import millis
from modengine.operators.reports import merge_stats

RATE_OUT = "user_id string, msg_id long, in_window long"
FLOOD_OUT = "user_id string, msg_id long, similar long"


def _batch(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ms", "msg_id"])


def _until(state: GroupState, ms: int) -> None:
    """End the state once the watermark passes ``ms``."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs()) + 1)


def _keyed(messages: DataFrame, delay: str, *columns) -> DataFrame:
    rows = messages.filter("user_id is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return rows.select(F.col("user_id").cast("string").alias("user_id"), "msg_id", "at", millis(F.col("at")).alias("ms"), *columns)


def rate_counts_stream(messages: DataFrame, seconds: int, delay: str = "1 minute") -> DataFrame:
    """(user_id, msg_id, in_window) as ``operators.limits.rate_counts`` gives on a table."""
    window = seconds * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        out = []
        for row in _batch(frames).itertuples():
            recent.append(int(row.ms))
            recent = [t for t in recent if t >= row.ms - window]
            out.append((key[0], int(row.msg_id), len(recent)))
        state.update((recent,))
        _until(state, recent[-1] + window)
        yield pd.DataFrame(out, columns=["user_id", "msg_id", "in_window"])

    return _keyed(messages, delay).groupBy("user_id").applyInPandasWithState(step, RATE_OUT, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def flood_counts_stream(messages: DataFrame, seconds: int, least: float, text_col: str = "normalized", delay: str = "1 minute") -> DataFrame:
    """(user_id, msg_id, similar): similar messages of the user before each one in the window."""
    window = seconds * 1000

    def alike(a: str, b: str) -> bool:
        longer = max(len(a), len(b))
        return longer == 0 or 1 - _distance(a, b) / longer >= least

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for row in _batch(frames).itertuples():
            recent = [m for m in recent if m[0] >= row.ms - window]
            out.append((key[0], int(row.msg_id), sum(alike(text, row.text) for _, text in recent)))
            recent.append((int(row.ms), row.text))
        state.update(([t for t, _ in recent], [text for _, text in recent]))
        _until(state, recent[-1][0] + window)
        yield pd.DataFrame(out, columns=["user_id", "msg_id", "similar"])

    return _keyed(messages, delay, F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("user_id").applyInPandasWithState(step, FLOOD_OUT, "times array<long>, texts array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def stats_sink(path: str):
    """A ``foreachBatch`` function: the statistics by user as a table that each batch replaces by a new version.

    A version is named by its batch, so a batch that runs again writes the same version from the same one before it.
    """

    def write(found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        empty = spark.createDataFrame([], "user_id string, violation_count long, last_violation timestamp")
        before = spark.read.schema(empty.schema).parquet(f"{path}/version={batch - 1}") if batch else empty
        merge_stats(before, found).write.mode("overwrite").parquet(f"{path}/version={batch}")

    return write
