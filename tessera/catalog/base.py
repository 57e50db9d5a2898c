"""Registration of queries with their DuckDB counterparts, and the bridge from the test tables to the data model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"
TENANTS = {"en": "acme", "fr": "globex", "de": "initech", "es": "umbrella"}
TENANT_TIERS = {"acme": "STANDARD", "globex": "PREMIUM", "initech": "FREE", "umbrella": "ENTERPRISE"}
SOURCES = ["warehouse_logs", "deployment_state", "git", "jira", "confluence", "release_notes"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def text(value: str | None) -> str:
    """A SQL string literal."""
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def case(column: str, values: dict[str, object], default: object = None) -> str:
    show = lambda v: text(v) if isinstance(v, str) or v is None else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {show(v)}" for k, v in values.items()) + f" ELSE {show(default)} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    """A DuckDB table of literal rows of strings and numbers."""
    show = lambda v: text(v) if isinstance(v, str) or v is None else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({names})"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tenant, tier, source type, title and creation time."""
    from tessera.schemas import choice

    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    tenant = choice(F.col("lang"), TENANTS, None)
    return (
        table(spark, sf_dir, "documents")
        .withColumn("tenant_id", tenant)
        .withColumn("tier", choice(F.col("tenant_id"), TENANT_TIERS, None))
        .withColumn("source_type", F.get(F.array(*map(F.lit, SOURCES)), number % 6))
        .withColumn("title", F.substring("text", 1, 60))
        .withColumn("created_at", F.expr("timestamp'2024-01-31 00:00:00' - make_dt_interval(cast(doc_id % 91 AS int))"))
    )


_indexes: dict[tuple, object] = {}


def keyword_index(spark: SparkSession, sf_dir: str):
    """The stored postings of the documents, written when they are first asked for, and anew when the table's files have changed."""
    from tessera.operators import postings
    from tessera.sources import scratch

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(path)
    version = (spark.sparkContext.applicationId, sf_dir, files.getFileStatus(path).getModificationTime(), size.getLength(), size.getFileCount())
    if version not in _indexes:
        _indexes[version] = postings.append(table(spark, sf_dir, "documents"), f"{scratch.root(spark)}/postings-{uuid.uuid4().hex}", 0)
    return _indexes[version]


DOCS = f"""docs AS (
    SELECT doc_id, text, lang, source, n_chars, {case('lang', TENANTS)} AS tenant_id, {case(case('lang', TENANTS), TENANT_TIERS)} AS tier,
    [{', '.join(map(text, SOURCES))}][TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 6 + 1] AS source_type,
    substr(text, 1, 60) AS title, TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 91 AS INTEGER)) AS created_at FROM documents)"""

LOGS = """logs AS (
    SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, concat('ns-', user_id % 3) AS namespace,
    concat('svc-', user_id % 10, '-', user_id) AS pod, concat(event_type, ' ', props) AS message, user_id FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("ns-"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("pod"),
        F.concat("event_type", F.lit(" "), "props").alias("message"),
        "user_id",
    )
