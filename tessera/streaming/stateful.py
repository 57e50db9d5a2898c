"""Stateful streams: admission limits and sessions, with the same folds as their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.limits import SlidingWindow, TokenBucket, full_after_ms


def _keyed(requests: DataFrame, key: str, time: str, order: str, late: str | None) -> DataFrame:
    """The requests with their time as the stream's, and with a watermark where state is to end."""
    timed = requests.select(key, order, F.col(time).cast("timestamp").alias("__at")).withColumn("__ms", F.unix_millis("__at"))
    return timed.withWatermark("__at", late) if late else timed


def _stepped(requests: DataFrame, key: str, time: str, order: str, late: str | None, open_state, keep, state_schema: str) -> DataFrame:
    """(key, order, admitted) by a fold whose state ends.

    ``open_state`` makes the fold of what was kept, or a new one; ``keep`` says what is kept of it and until when, in milliseconds, it differs
    from a new one. Once the watermark (the newest request less ``late``) has passed that, the key's state is removed. Requests
    later than that get no answer. Without ``late`` none is dropped, and the state stays.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, order)}

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = open_state(state.get if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["__ms", order])
        admitted = [own.admit(int(now)) for now in rows["__ms"]]
        kept, until = keep(own)
        state.update(kept)
        if late:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key], order: rows[order], "admitted": admitted})

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return _keyed(requests, key, time, order, late).groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, admitted boolean", state_schema, "append", timeout)


def admission_stream(requests: DataFrame, limit: int, window_ms: int = 1000, key: str = "user_id", time: str = "ts", order: str = "event_id", late: str | None = None) -> DataFrame:
    """(key, order, admitted): a sliding window for each key; state is the admitted times within the window, and ends with it (see :func:`_stepped`)."""

    def opened(kept: tuple | None) -> SlidingWindow:
        own = SlidingWindow(limit, window_ms)
        own.times.extend(kept[0] if kept else ())
        return own

    return _stepped(requests, key, time, order, late, opened, lambda own: ((list(own.times),), (own.times[-1] if own.times else 0) + window_ms), "times array<long>")


def bucket_stream(requests: DataFrame, rate: float = 100, burst: float = 200, key: str = "user_id", time: str = "ts", order: str = "event_id", late: str | None = None) -> DataFrame:
    """(key, order, admitted): a token bucket for each key; its state ends when the bucket is full again."""

    def opened(kept: tuple | None) -> TokenBucket:
        own = TokenBucket(rate, burst)
        own.tokens, own.at = kept or (burst, None)
        return own

    return _stepped(requests, key, time, order, late, opened, lambda own: ((float(own.tokens), int(own.at)), int(own.at) + full_after_ms(rate, burst)), "tokens double, at long")


def session_stream(events: DataFrame, key: str = "user_id", time: str = "ts", minutes: int = 30, watermark: str | None = "1 hour") -> DataFrame:
    """Sessions as they close; without a watermark nothing late is dropped (and the state never shrinks)."""
    own = events.withColumn("at", F.col(time).cast("timestamp"))
    if watermark:
        own = own.withWatermark("at", watermark)
    return own.groupBy(F.session_window("at", f"{minutes} minutes").alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "n")


def deduplicated_stream(events: DataFrame, keys: list[str], time: str, watermark: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark, across batches."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, size: str = "1 hour", by: str = "event_type", time: str = "ts", watermark: str | None = None) -> DataFrame:
    """Tumbling counts; an extension, in batch and stream alike."""
    own = events.withColumn("at", F.col(time).cast("timestamp"))
    if watermark:
        own = own.withWatermark("at", watermark)
    return own.groupBy(F.window("at", size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
