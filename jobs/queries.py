"""The jobs as registered queries: each runs twice into one new folder, and what then stands there is compared with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_documents, log_rollup
from tessera.catalog.base import DOCS
from tessera.catalog.texts import chunk_end
from tessera.sources import scratch


def _folder(spark: SparkSession, job: str) -> str:
    return f"{scratch.root(spark)}/{job}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that two runs over ``documents`` leave: pieces, and the documents that cannot be indexed."""
    out = _folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", out)
    failed = index_documents.table(spark, f"{out}/failed", index_documents.FAILED)
    pieces = index_documents.current(spark, out).select("doc_id", "index_name", "chunk_index", "chunk_text")
    return pieces.unionByName(failed.select("doc_id", F.col("target").alias("index_name"), F.lit(None).cast("int").alias("chunk_index"), F.col("failure").alias("chunk_text")))


def job2_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup that two runs over ``events`` leave."""
    out = _folder(spark, "job2")
    for _ in range(2):
        log_rollup.run(spark, f"{sf_dir}/events.parquet", out)
    return log_rollup.rollup(spark, out).withColumn("day", F.col("day").cast("string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_index_documents": job1_index_documents, "job2_log_rollup": job2_log_rollup}

ORACLES: dict[str, str] = {
    "job1_index_documents": f"""WITH RECURSIVE {DOCS}, e AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, tenant_id, tier, title, text,
      CASE WHEN doc_id IS NULL THEN 'doc_id is missing' WHEN tenant_id IS NULL THEN 'tenant_id is missing' WHEN trim(coalesce(text, '')) = '' THEN 'content is empty' END AS failure FROM docs),
    d AS (SELECT doc_id, tier, tenant_id, regexp_replace(title || chr(10) || chr(10) || substr(text, 1, 750000), '^\\s+|\\s+$', '', 'g') AS t FROM e WHERE failure IS NULL),
    c(doc_id, t, first, last) AS (SELECT doc_id, t, CAST(0 AS BIGINT), {chunk_end("0")} FROM d UNION ALL SELECT doc_id, t, last - 200, {chunk_end("(last - 200)")} FROM c WHERE last < length(t) AND last > 200),
    p AS (SELECT doc_id, first, regexp_replace(substr(t, first + 1, last - first), '^\\s+|\\s+$', '', 'g') AS chunk_text FROM c),
    n AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS chunk_index, chunk_text FROM p WHERE chunk_text <> '')
    SELECT doc_id, CASE WHEN tier = 'ENTERPRISE' THEN 'chunks-' || lower(tenant_id) ELSE 'chunks-shared' END AS index_name, chunk_index, chunk_text FROM n JOIN d USING (doc_id)
    UNION ALL SELECT doc_id, 'retry-1', NULL, failure FROM e WHERE failure IS NOT NULL""",
    "job2_log_rollup": """WITH r AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS e, 'ns-' || user_id % 3 AS namespace,
      'svc-' || user_id % 10 AS service, user_id, concat_ws(' ', event_type, props) AS message FROM events),
    h AS (SELECT day, hour, namespace, service, count(*) AS n, CAST(sum(e) AS BIGINT) AS n_errors, count(DISTINCT user_id) AS n_pods FROM r GROUP BY ALL),
    m AS (SELECT day, namespace, message, count(*) AS n FROM r WHERE e = 1 GROUP BY ALL),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, namespace ORDER BY n DESC, message) AS INTEGER) AS place FROM m QUALIFY place <= 3),
    d AS (SELECT day, namespace, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_errors) AS BIGINT) AS n_errors, round(sum(n_errors) / sum(n), 6) AS error_share FROM h GROUP BY ALL),
    b AS (SELECT *, lag(error_share) OVER (PARTITION BY namespace ORDER BY day) AS previous_share FROM d)
    SELECT CAST(day AS VARCHAR) AS day, 'hourly' AS grain, hour, namespace, service, n, n_errors, n_pods, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS INTEGER) AS place, CAST(NULL AS DOUBLE) AS error_share,
      CAST(NULL AS DOUBLE) AS previous_share, CAST(NULL AS BOOLEAN) AS regressed, CAST(NULL AS VARCHAR) AS top_error, CAST(NULL AS BIGINT) AS top_error_n FROM h
    UNION ALL SELECT CAST(day AS VARCHAR), 'errors', NULL, namespace, NULL, n, NULL, NULL, message, place, NULL, NULL, NULL, NULL, NULL FROM t
    UNION ALL SELECT CAST(b.day AS VARCHAR), 'daily', NULL, b.namespace, NULL, b.n, n_errors, NULL, NULL, NULL, error_share, previous_share, coalesce(error_share > previous_share * 1.1, false), t.message, t.n
      FROM b LEFT JOIN t ON t.day = b.day AND t.namespace = b.namespace AND t.place = 1""",
}
