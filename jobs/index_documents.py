"""Incremental indexing: files of documents that have come since the last run become chunks, index by index.

A file stream with a checkpoint takes only new files. Of these, documents whose fingerprint is the one last indexed are
left out; the rest are split by the library's indexing plan; what cannot be indexed goes to the retry table. Each table is partitioned by batch:

    out/chunks/batch=/index_name=     pieces of the documents of a batch
    out/failed/batch=/target=         documents that cannot be indexed, with the reason
    out/documents/batch=/index_name=  the documents of a batch, written last: they say which pieces count
    out/checkpoint                    which files were taken

A batch that is repeated, after a crash or from an older checkpoint, overwrites its own partitions with the same rows. A
reader takes each document's newest batch (:func:`current`), so it never sees pieces of a batch that is not whole.

    python -m jobs.index_documents --documents s3a://lake/documents --out s3a://lake/index [--config own.json]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import configured, session
from tessera.schemas import choice
from tessera.sources.tables import replace_partitions, table
from tessera.streaming.indexing import last_indexed, processed

log = logging.getLogger("index_documents")

DOCUMENTS = "doc_id long, text string, lang string, source string"
CHUNKS = "doc_id string, chunk_index int, chunk_text string, tenant_id string, tier string, title string, created_at long, chunk_id string, batch long, index_name string"
INDEXED = "doc_id string, tenant_id string, title string, fingerprint string, created_at long, batch long, index_name string"
FAILED = "doc_id string, tenant_id string, failure string, retry_count int, retry_after long, batch long, target string"


def events(files: DataFrame, config: dict) -> DataFrame:
    """Indexing events of the rows of document files; a later file's version of a document is the newer one."""
    tenant = choice(F.col("lang"), config["tenants"], None)
    return files.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        tenant.alias("tenant_id"),
        choice(tenant, config["tiers"], "STANDARD").alias("tier"),
        F.substring("text", 1, config["title_chars"]).alias("title"),
        F.col("text").alias("content"),
        F.unix_millis("_metadata.file_modification_time").alias("created_at"),
    )


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Index what is new under ``documents``; returns the rows written to each table."""
    config = config or configured(__file__)
    written = {"batches": 0, "chunks": 0, "failed": 0, "documents": 0}
    for name, schema in (("chunks", CHUNKS), ("failed", FAILED), ("documents", INDEXED)):
        table(spark, f"{out}/{name}", schema)

    def each(rows: DataFrame, batch: int) -> None:
        own = rows.persist()
        try:
            log.info("batch %d: %d rows read", batch, own.count())
            indexed = own.sparkSession.read.schema(INDEXED).parquet(f"{out}/documents")
            made = processed(own, last_indexed(indexed, own, batch), None, F.col("created_at"))
            for name, part, schema, by in (("chunks", made.chunks, CHUNKS, "index_name"), ("failed", made.failed, FAILED, "target"), ("documents", made.documents, INDEXED, "index_name")):
                columns = [c.split()[0] for c in schema.split(", ")]
                replace_partitions(part.withColumn("batch", F.lit(batch).cast("long")).select(*columns), f"{out}/{name}", "batch", by)
                n = own.sparkSession.read.schema(schema).parquet(f"{out}/{name}").filter(F.col("batch") == batch).count()
                written[name] += n
                log.info("batch %d: %d rows to %s/%s", batch, n, out, name)
            written["batches"] += 1
        finally:
            own.unpersist()

    log.info("reading new files of %s", documents)
    path = documents.rstrip("/")
    path = path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"  # as a pattern it may also be a single file
    files = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(path)
    stream = events(files, config).writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("done: %s", written)
    return written


def current(spark: SparkSession, out: str) -> DataFrame:
    """The pieces of each document's newest batch."""
    newest = table(spark, f"{out}/documents", INDEXED).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return table(spark, f"{out}/chunks", CHUNKS).join(newest, ["doc_id", "batch"])


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--documents", required=True, help="Parquet files of documents: a folder, a file or a pattern")
    parser.add_argument("--out", required=True, help="folder of the tables and of the checkpoint")
    parser.add_argument("--config", help="JSON file with settings that differ from jobs/index_documents.json")
    own = parser.parse_args()
    spark = session("index_documents")
    try:
        run(spark, own.documents, own.out, configured(__file__, own.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
