"""Job events as streams: progress by window, throttled progress, a queue without repeats, and the life cycle of jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.control import advance


def status_counts(events: DataFrame, time: str, status: str, window: str = "1 day", late: str = "48 hours") -> DataFrame:
    """Events by window and status; what comes later than `late` is left out of a stream."""
    timed = events.withWatermark(time, late)
    counts = timed.groupBy(F.window(time, window).alias("w"), status).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), status, "n")


def throttle(events: DataFrame, key: str, time: str, row: str, seconds: float = 1.5, late: str = "48 hours") -> DataFrame:
    """key, row of the events that come `seconds` or more after the last one let through, with state per key.

    Within a trigger, events of a key are taken in order of time. State goes when a key is silent for `late`.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values(["_t", row])
        out = []
        for t, i in zip(rows["_t"], rows[row]):
            if t - last >= seconds:
                last = t
                out.append(i)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000) + 172_800_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(out), row: out})

    kinds = dict(events.dtypes)
    timed = events.withWatermark(time, late).withColumn("_t", F.col(time).cast("double"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {row} {kinds[row]}", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def enqueued(events: DataFrame, key: str, time: str, late: str = "48 hours") -> DataFrame:
    """The first event of each key: a queue that takes a job once, however often it is sent within `late`."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def lifecycle(events: DataFrame, key: str, time: str, row: str, command: str, late: str = "48 hours") -> DataFrame:
    """key, row, state of the commands that were allowed, with state per key: see operators.control.lifecycle.

    Within a trigger, commands of a key are taken in order of time. State goes when a key is silent for `late`.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["_t", row])
        out = []
        for c, i in zip(rows[command], rows[row]):
            after = advance(now, c)
            if after is not None:
                now = after
                out.append((group[0], i, after))
        state.update((now,))
        state.setTimeoutTimestamp(max(int(rows["_t"].max() * 1000) + 172_800_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, row, "state"])

    kinds = dict(events.dtypes)
    timed = events.withWatermark(time, late).withColumn("_t", F.col(time).cast("double"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {row} {kinds[row]}, state string", "state string", "append", GroupStateTimeout.EventTimeTimeout)
