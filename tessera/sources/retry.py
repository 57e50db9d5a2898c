"""Retry tiers and the dead-letter table: routing as columns, so a failed row never fails its batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAYS_MS = (300_000, 1_800_000, 7_200_000)
PATIENCE_MS = 30_000
CONTROL = ("retry-count", "retry-after", "failure-reason", "original-topic")


def routed(failed: DataFrame, now_ms: Column) -> DataFrame:
    """Adds target (retry-1..3 or dlq), the next retry_count and retry_after; the dead-letter row keeps its count."""
    following = F.coalesce("retry_count", F.lit(0)) + 1
    delay = F.element_at(F.array(*map(F.lit, DELAYS_MS)), F.least(following, F.lit(len(DELAYS_MS))).cast("int"))
    dead = following > len(DELAYS_MS)
    return failed.withColumns(
        {
            "target": F.when(dead, "dlq").otherwise(F.concat(F.lit("retry-"), following.cast("string"))),
            "retry_after": F.when(~dead, now_ms + delay),
            "retry_count": F.when(dead, following - 1).otherwise(following),
        }
    )


def ready(retry_after: Column, now_ms: Column) -> Column:
    """Whether a row may run; a longer wait goes back to its queue."""
    return retry_after - now_ms <= PATIENCE_MS


def clean_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*CONTROL))


def original_topic(headers: Column, topic: Column) -> Column:
    """The topic a row came from first."""
    return F.coalesce(F.try_element_at(headers, F.lit("original-topic")), topic)
