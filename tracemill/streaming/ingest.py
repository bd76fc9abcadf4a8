"""The live path: journals as a stream, sessions closed when idle, deferred ingests coalesced."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.functions import fixed

CLOSED = "session string, started timestamp, ended timestamp, prompts long, calls long, edits long, reason string"
STATE = "started long, ended long, prompts long, calls long, edits long"


def coalesced(queue: DataFrame, *keys: str) -> DataFrame:
    """Pending ingests by key: ended if any says so. Works on a stream (update mode) and on a table."""
    return queue.groupBy(*keys).agg(F.bool_or("ended").alias("ended"), F.count("*").alias("queued"))


def _micros(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


def close_sessions(events: DataFrame, idle_seconds: int = fixed.IDLE_SECONDS, late_seconds: int = 60) -> DataFrame:
    """One row for each session that stays idle, by event time; a later event opens a new one.

    events: session, at, type, action. The state of a session is five counters, whatever its length.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []

        def close(s: tuple, reason: str) -> None:
            out.append((key[0], pd.Timestamp(s[0], unit="us"), pd.Timestamp(s[1], unit="us"), *s[2:], reason))

        if state.hasTimedOut:
            close(state.get, "idle")
            state.remove()
        else:
            now = state.get if state.exists else None
            for frame in frames:
                frame = frame.assign(us=_micros(frame["at"])).sort_values("us", kind="stable")
                for us, kind, action in zip(frame["us"], frame["type"], frame["action"], strict=True):
                    if now is not None and us - now[1] > idle_seconds * 1_000_000:
                        close(now, "resumed")
                        now = None
                    started, ended, prompts, calls, edits = now or (us, us, 0, 0, 0)
                    now = (min(started, us), max(ended, us), prompts + (kind == "prompt"), calls + (kind == "tool_call"), edits + (action == "edit"))
            if now is not None:
                state.update(tuple(int(x) for x in now))
                state.setTimeoutTimestamp(max(now[1] // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])

    rows = events.select("session", "at", "type", F.coalesce("action", F.lit("")).alias("action")).withWatermark("at", f"{late_seconds} seconds")
    return rows.groupBy("session").applyInPandasWithState(run, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def new_events(events: DataFrame, progress: DataFrame) -> DataFrame:
    """Events past each session's high-water mark (session, extracted_through, ended); sessions without one are new."""
    marks = progress.select("session", F.col("extracted_through").alias("__mark"))
    return events.join(marks, "session", "left").where(F.col("__mark").isNull() | (F.col("seq") > F.col("__mark"))).drop("__mark")


def advanced(progress: DataFrame, seen: DataFrame) -> DataFrame:
    """Progress after a batch: the highest mark of either side, ended if either is."""
    rows = progress.select("session", "extracted_through", "ended").unionByName(seen.select("session", "extracted_through", "ended"))
    return rows.groupBy("session").agg(F.max("extracted_through").alias("extracted_through"), F.bool_or("ended").alias("ended"))


def remind_once(reminders: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream's first row of each key, as far as the watermark reaches."""
    return reminders.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
