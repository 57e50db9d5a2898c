"""Admission limits in batch form: sliding windows, token buckets, circuit breakers. Each is a fold over a key's requests in order.

A key's requests stream through its task in Arrow batches sorted by time; only the window or the bucket is held. Where a
key was silent long enough for its window to empty or its bucket to fill, its requests are dealt to several tasks. Limits of one
key do not depend on another.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SlidingWindow:
    """Admits while fewer than ``limit`` admitted requests lie within the window; refused ones are not recorded."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window, self.times = limit, window_ms, deque()

    def admit(self, now: int) -> bool:
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(now)
        return True


class TokenBucket:
    """Refills at ``rate`` a second up to ``burst``; a request takes one token."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst, None

    def admit(self, now: int) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0, now - self.at) * self.rate / 1000)
        self.at = now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


def full_after_ms(rate: float, burst: float) -> int:
    """After so long without a request a bucket is full, as a new one is."""
    return math.ceil(1000 * burst / rate)


class CircuitBreaker:
    """Opens when at least ``share`` of the last ``window`` calls failed (once ``least`` are known), closes after good probes."""

    def __init__(self, window: int = 10, share: float = 0.5, least: int = 10, open_ms: int = 30_000, probes: int = 3):
        self.calls: deque[bool] = deque(maxlen=window)
        self.share, self.least, self.open_ms, self.probes = share, least, open_ms, probes
        self.opened: int | None = None
        self.trial: list[bool] | None = None

    def call(self, now: int, fails: bool) -> str:
        """State under which the call ran, or ``rejected``."""
        if self.opened is not None:
            if now - self.opened < self.open_ms:
                return "rejected"
            self.opened, self.trial = None, []
        if self.trial is not None:
            self.trial.append(fails)
            if len(self.trial) == self.probes:
                if sum(self.trial) >= self.share * self.probes:
                    self.opened = now
                self.trial = None
                self.calls.clear()
            return "half_open"
        self.calls.append(fails)
        if len(self.calls) >= self.least and sum(self.calls) >= self.share * len(self.calls):
            self.opened = now
            self.calls.clear()
        return "closed"


def _cut(rows: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Adds ``__part``: runs of a key's requests with more than ``gap_ms`` of silence between them, where no state is left.

    Requests fall into slots of that length; an empty slot between two is such a silence. Only the slots of a key, not
    its requests, are put in order; requests then meet their slot, so a key on all rows is dealt over all tasks.
    """
    slots = rows.withColumn("__slot", F.floor(F.col("__ms") / F.lit(gap_ms)))
    own = f"OVER (PARTITION BY `{key}` ORDER BY __slot)"
    seen = slots.select(key, "__slot").distinct().withColumn("__new", F.expr(f"CASE WHEN __slot - lag(__slot) {own} < 2 THEN 0 ELSE 1 END"))
    parts = seen.select(F.col(key).alias("__key"), F.col("__slot").alias("__at"), F.expr(f"sum(__new) {own}").alias("__part"))
    return slots.join(parts, slots[key].eqNullSafe(parts["__key"]) & slots["__slot"].eqNullSafe(parts["__at"])).drop("__slot", "__key", "__at")


def _folded(requests: DataFrame, key: str, time: str, order: str, fold, column: str, kind: str, extra: str | None = None, gap_ms: int | None = None) -> DataFrame:
    """Rows of each key in time order through one fold: dealt by hash, sorted within partitions, then streamed.

    After ``gap_ms`` without a request the fold is as new, so a key's runs between such gaps go to different tasks.
    """
    columns = [key, time, order] + ([extra] if extra else [])
    rows = requests.select(*columns).withColumn("__ms", F.unix_millis(F.col(time).cast("timestamp")))
    rows = _cut(rows, key, gap_ms) if gap_ms else rows.withColumn("__part", F.lit(0).cast("long"))
    dealt = rows.select(key, order, "__ms", "__part", *([extra] if extra else [])).repartition(F.col(key), F.col("__part")).sortWithinPartitions(key, "__part", "__ms", order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            out = []
            for own, part, now, more in zip(*(batch.column(i).to_pylist() for i in (0, 3, 2)), batch.column(4).to_pylist() if extra else [None] * len(batch), strict=True):
                if (own, part) != current:
                    current, state = (own, part), fold(own)
                out.append(None if now is None else state(now, more))  # a request without a time is not judged
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string() if kind == "string" else pa.bool_())], [key, order, column])

    kinds = [requests.schema[c].dataType.simpleString() for c in (key, order)]
    return dealt.mapInArrow(run, f"`{key}` {kinds[0]}, `{order}` {kinds[1]}, `{column}` {kind}")


def sliding_admission(requests: DataFrame, limit: int, window_ms: int = 1000, key: str = "user_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    def fold(_):
        own = SlidingWindow(limit, window_ms)
        return lambda now, _: own.admit(now)

    return _folded(requests, key, time, order, fold, "admitted", "boolean", gap_ms=window_ms)


def bucket_admission(requests: DataFrame, rate: float = 100, burst: float = 200, key: str = "user_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    def fold(_):
        own = TokenBucket(rate, burst)
        return lambda now, _: own.admit(now)

    return _folded(requests, key, time, order, fold, "admitted", "boolean", gap_ms=full_after_ms(rate, burst))


def breaker_states(calls: DataFrame, failed: str, key: str = "user_id", time: str = "ts", order: str = "event_id", **settings) -> DataFrame:
    def fold(_):
        own = CircuitBreaker(**settings)
        return lambda now, fails: own.call(now, bool(fails))

    return _folded(calls, key, time, order, fold, "state", "string", failed)


def raw_rate(requests: DataFrame, window_ms: int = 1000, key: str = "user_id", time: str = "ts") -> DataFrame:
    """How many requests of the key lie in the window that ends with each request: a range frame."""
    frame = f"count(*) OVER (PARTITION BY `{key}` ORDER BY unix_millis(cast(`{time}` AS timestamp)) RANGE BETWEEN {window_ms - 1} PRECEDING AND CURRENT ROW)"
    return requests.withColumn("rate", F.expr(frame))
