"""Responses kept for a while, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, now: int, ttl: int = 60, key: str | None = None) -> DataFrame:
    fresh = rows.filter(F.lit(now) - F.col("stored_at") < ttl)
    return fresh if key is None else fresh.filter(F.col("key") == key)


def invalidated(rows: DataFrame, tenant: str) -> DataFrame:
    """Without the tenant's responses: one of its documents changed."""
    return rows.filter(F.col("tenant_id") != tenant)
