"""The retry stream: rows that are due are processed again, others stay in their queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import reason
from tessera.sources.retry import clean_headers, original_topic, ready, routed


def split_due(queue: DataFrame, now_ms: Column) -> tuple[DataFrame, DataFrame]:
    """(due, waiting): no task ever sleeps; what waits is written back."""
    own = queue.withColumn("__ready", ready(F.col("retry_after"), now_ms))
    return own.filter("__ready").drop("__ready"), own.filter("NOT __ready").drop("__ready")


def republished(failed: DataFrame, message: Column, now_ms: Column) -> DataFrame:
    """Failed rows with their next target, trimmed reason, own headers only and the topic they first came from."""
    return routed(failed, now_ms).withColumns({"failure_reason": reason(message), "original_topic": original_topic(F.col("headers"), F.col("topic")), "headers": clean_headers(F.col("headers"))})
