"""Streaming operators run over the tables until the input is used up; their batch forms are the reference."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.base import DOCS, docs, query, table
from tessera.catalog.records import ADMISSION
from tessera.catalog.texts import chunk_end
from tessera.sources import scratch
from tessera.streaming import indexing, stateful


def _scratch(spark: SparkSession) -> str:
    return f"{scratch.root(spark)}/streams/{uuid.uuid4().hex}"


def _drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


@query("stream_admission", ADMISSION)
def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(stateful.admission_stream(_event_stream(spark, sf_dir), 2, 3_600_000), _scratch(spark))


@query("window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.windowed_counts(table(spark, sf_dir, "events"), "1 day").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "index_batch_documents",
    f"WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, tenant_id, CASE WHEN tier = 'ENTERPRISE' THEN 'documents-' || lower(tenant_id) ELSE 'documents-shared' END AS index_name FROM docs WHERE trim(coalesce(text, '')) <> ''",
)
def index_batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.processed(_events(spark, sf_dir), None, None, F.lit(0)).documents.select("doc_id", "tenant_id", "index_name")


@query(
    "index_batch_chunks",
    f"""WITH RECURSIVE {DOCS}, d AS (SELECT doc_id, tier, tenant_id, regexp_replace(coalesce(title, '') || chr(10) || chr(10) || text, '^\\s+|\\s+$', '', 'g') AS t FROM docs WHERE trim(coalesce(text, '')) <> ''),
    c(doc_id, t, first, last) AS (SELECT doc_id, t, CAST(0 AS BIGINT), {chunk_end("0")} FROM d UNION ALL SELECT doc_id, t, last - 200, {chunk_end("(last - 200)")} FROM c WHERE last < length(t) AND last > 200),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS i FROM c WHERE trim(substr(t, first + 1, last - first)) <> '')
    SELECT doc_id || '-chunk-' || i AS chunk_id, CASE WHEN tier = 'ENTERPRISE' THEN 'chunks-' || lower(tenant_id) ELSE 'chunks-shared' END AS index_name, 64 AS dimensions, 'hashed-words-1' AS embedding_version FROM p JOIN d USING (doc_id)""",
)
def index_batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.embedding import hashed_words

    return indexing.processed(_events(spark, sf_dir), None, hashed_words, F.lit(0)).chunks.select("chunk_id", "index_name", F.size("embedding").alias("dimensions"), "embedding_version")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexing events, one of each more than once."""
    own = docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"), "tenant_id", "tier", "title", F.col("text").alias("content"), F.create_map(F.lit("source"), F.col("source_type")).alias("metadata"), F.unix_millis("created_at").alias("created_at"), F.col("doc_id").cast("string").alias("idempotency_key")
    )
    return own.unionByName(own.filter("tenant_id = 'globex'").withColumn("created_at", F.col("created_at") - 1))
