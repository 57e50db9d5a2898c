"""The indexing stream: events in, documents and chunks out, failures to retry tiers or the dead-letter table.

Each micro-batch is an ordinary DataFrame job, so a replayed batch writes the same rows again under the same batch id
and the tables stay idempotent. Bad data is a row, never an exception.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.chunking import chunked
from tessera.functions.embedding import Embedder, embedded
from tessera.functions.text import embedding_text, fingerprint
from tessera.operators import postings
from tessera.operators.upsert import latest
from tessera.schemas import index_name
from tessera.sources.retry import routed
from tessera.sources.tables import exists


@dataclass(frozen=True)
class Batch:
    """What one micro-batch makes."""

    documents: DataFrame
    chunks: DataFrame
    failed: DataFrame


def invalid(event: DataFrame) -> Column:
    """Why an event cannot be indexed, else null."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(blank(F.col("doc_id")), "doc_id is missing").when(blank(F.col("tenant_id")), "tenant_id is missing").when(blank(F.col("content")), "content is empty")


def processed(events: DataFrame, stored: DataFrame | None, embedder: Embedder | None, now_ms: Column) -> Batch:
    """Last event of each document wins; documents whose fingerprint is stored are skipped; the rest are split and embedded."""
    if "retry_count" not in events.columns:
        events = events.withColumn("retry_count", F.lit(0))
    marked = events.withColumn("failure", invalid(events))
    good = latest(marked.filter("failure IS NULL").drop("failure"), ["doc_id"], ["created_at", "content", "title"])  # of one instant, the same one on every run
    documents = good.withColumns({"fingerprint": fingerprint(F.col("title"), F.col("content")), "index_name": index_name("documents", F.col("tenant_id"), F.col("tier"))})
    if stored is not None:
        known = stored.select("doc_id", F.col("fingerprint").alias("known"))
        documents = documents.join(known, "doc_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("known"))).drop("known")
    keep = ["tenant_id", "tier", "title", "created_at"]  # carried by the splitter: no join back to the documents
    chunks = chunked(documents.withColumn("text", embedding_text(F.col("title"), F.col("content"))), "sentence", keep=keep)
    chunks = chunks.withColumns({"chunk_id": F.concat_ws("-chunk-", "doc_id", F.col("chunk_index").cast("string")), "index_name": index_name("chunks", F.col("tenant_id"), F.col("tier"))})
    if embedder is not None:
        chunks = embedded(chunks, "chunk_text", embedder)
    failed = routed(marked.filter("failure IS NOT NULL"), now_ms)
    return Batch(documents, chunks, failed)


KNOWN = "doc_id string, fingerprint string, batch long"


def last_indexed(indexed: DataFrame, incoming: DataFrame, batch: int) -> DataFrame:
    """(doc_id, fingerprint) that earlier batches stored last for the incoming documents: history is scanned, only theirs is shuffled."""
    known = indexed.filter(F.col("batch") < batch).select("doc_id", "fingerprint", "batch")
    return latest(known.join(incoming.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"], ["batch"])


def write_batch(batch: Batch, folder: str, batch_id: int) -> None:
    """Write the batch under its own id: a repeated batch overwrites what it wrote before. A row in ``batches`` comes last
    and says that the batch is whole, see :func:`published`."""
    for name, rows, by in (("chunks", batch.chunks, ["index_name"]), ("failed", batch.failed, ["target"]), ("documents", batch.documents, ["index_name"])):
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}/batch={batch_id}")
    batch.documents.sparkSession.range(1).select(F.current_timestamp().alias("written_at")).write.mode("overwrite").parquet(f"{folder}/batches/batch={batch_id}")


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table of those batches only that are whole; a batch that is being written, or broke, is not there yet."""
    return spark.read.parquet(f"{folder}/{name}").join(spark.read.parquet(f"{folder}/batches").select("batch"), "batch", "left_semi")


def start(events: DataFrame, folder: str, embedder: Embedder | None = None, available_now: bool = False, seconds: int = 5, keywords: str | None = None):
    """Run the stream; with ``available_now`` until the input is used up. Documents that come again unchanged are not split again.
    ``keywords`` is where it keeps stored postings of titles and contents up."""

    def each(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            spark = rows.sparkSession
            known = last_indexed(spark.read.schema(KNOWN).parquet(f"{folder}/documents"), rows, batch_id) if exists(spark, f"{folder}/documents") else None
            batch = processed(rows, known, embedder, F.unix_millis(F.current_timestamp()))
            write_batch(batch, folder, batch_id)
            if keywords:
                postings.append(batch.documents.withColumn("text", embedding_text(F.col("title"), F.col("content"))), keywords, batch_id)
        finally:
            rows.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The tables' newest rows over all batches."""
    return latest(rows, keys, ["created_at", "batch_id"])
