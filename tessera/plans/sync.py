"""A sync cycle: what changed since the watermark, written idempotently; stale sources purged after a full cycle only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.upsert import delta, latest, merged, purge, stable_id
from tessera.sources.state import updated


@dataclass(frozen=True)
class Cycle:
    documents: DataFrame
    chunks: DataFrame
    tracking: DataFrame
    state: DataFrame


def synced(items: DataFrame, documents: DataFrame, chunks: DataFrame, tracking: DataFrame, state: DataFrame, tenant: str, source: str, watermark: Column | None, started: Column, overlap_seconds: int = 60) -> Cycle:
    """``items`` hold source_id, title, content and updated; without a watermark the cycle is a full one.

    Lazy like any plan: the caller writes the documents first and the state last, so a failed write leaves the old stamp.
    """
    full = watermark is None
    fresh = items if full else delta(items, watermark, overlap_seconds)
    keyed = fresh.withColumns({"doc_id": stable_id(F.lit(tenant), F.lit(source), F.col("source_id"), F.lit(None).cast("string"), F.lit(None).cast("int")), "tenant_id": F.lit(tenant)})
    keyed = latest(keyed, ["doc_id"], ["updated"])
    rows = merged(documents, keyed.select(*documents.columns), ["doc_id"], ["updated"])
    seen = keyed.select("source_id", F.lit(source).alias("source_type"), "tenant_id", "doc_id", started.alias("last_seen_at"))
    followed = merged(tracking, seen.select(*tracking.columns), ["source_id", "source_type", "tenant_id"], ["last_seen_at"])
    own = (F.col("tenant_id") == tenant) & (F.col("source_type") == source)
    rows, pieces, kept = purge(rows, chunks, followed.filter(own), started, full)
    stamp = items.sparkSession.range(1).select(F.lit(f"{source}:{tenant}").alias("key"), F.unix_timestamp(started).cast("string").alias("value"))
    return Cycle(rows, pieces, followed.filter(~own).unionByName(kept), updated(state, stamp))


