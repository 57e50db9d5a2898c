"""Keyed writes on Parquet tables: latest wins, first wins, deletes with cascade, change detection, stale purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fingerprint
from tessera.session import spread


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One shuffle of the keys' rows; max_by keeps one row a key and map task."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row"))
    return picked.select(*keys, "row.*").select(*rows.columns)


def merged(table: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``table`` with ``updates`` on top: the latest row of each key over both."""
    return latest(table.unionByName(updates), keys, order)


def first_wins(table: DataFrame, additions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``table`` and those additions whose key it lacks, each once."""
    fresh = additions.join(table.select(*keys), keys, "left_anti")
    others = [c for c in additions.columns if c not in keys]
    once = fresh.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("row")).select(*keys, "row.*") if others else fresh.select(*keys).distinct()
    return table.unionByName(once.select(*table.columns))


def without(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys), keys, "left_anti")


def surplus_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of re-indexed documents that the fresh split no longer has."""
    touched = stored.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi")
    return touched.join(fresh.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")


def changed(incoming: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Incoming documents whose fingerprint is new or differs from the stored one; others are neither split nor embedded again."""
    marked = spread(incoming).withColumn("fingerprint", fingerprint(F.col("title"), F.col("content")))
    known = stored.select(key, F.col("fingerprint").alias("known"))
    return marked.join(known, key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("known"))).drop("known")


def work_list(remote: DataFrame, state: DataFrame, key: str = "key", version: str = "sha") -> DataFrame:
    """Remote items whose version the state does not hold."""
    return remote.join(state.select(key, version), [key, version], "left_anti")


def delta(rows: DataFrame, watermark: Column, overlap_seconds: int, updated: str = "updated") -> DataFrame:
    return rows.filter(F.col(updated) >= watermark - F.expr(f"INTERVAL {overlap_seconds} SECONDS"))


def stale(tracking: DataFrame, cutoff: Column) -> DataFrame:
    """Tracked sources that a full sync did not see."""
    return tracking.filter(F.col("last_seen_at") < cutoff)


def purge(documents: DataFrame, chunks: DataFrame, tracking: DataFrame, cutoff: Column, full_sync: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and tracking without stale sources; a delta sync purges nothing."""
    if not full_sync:
        return documents, chunks, tracking
    gone = stale(tracking, cutoff).select("doc_id").filter("doc_id IS NOT NULL").distinct()
    return without(documents, gone, ["doc_id"]), without(chunks, gone, ["doc_id"]), tracking.filter(F.col("last_seen_at") >= cutoff)


def document_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """INDEXED where chunks exist, else PENDING."""
    indexed = chunks.select("doc_id").distinct().withColumn("status", F.lit("INDEXED"))
    return documents.drop("status").join(indexed, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


def stable_id(tenant: Column, source: Column, source_id: Column, branch: Column, part: Column) -> Column:
    """An id that the same source item always gets, so a repeated sync overwrites."""
    return F.sha2(F.concat_ws("\u0001", tenant, source, source_id, F.coalesce(branch, F.lit("")), F.coalesce(part.cast("string"), F.lit("0"))), 256)
