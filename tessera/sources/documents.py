"""Creating and deleting documents: validation, quota, the event each creation emits, seed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.context import TenantContext, over_quota
from tessera.operators.upsert import stable_id, without

TITLE_LIMIT, CONTENT_LIMIT = 500, 1_000_000


def rejected(title: Column, content: Column, title_limit: int = TITLE_LIMIT, content_limit: int = CONTENT_LIMIT) -> Column:
    """The field that a creation request fails on, else null."""
    bad = lambda c, n: F.coalesce((F.trim(c) == "") | (F.length(c) > n), F.lit(True))
    return F.when(bad(title, title_limit), "title").when(bad(content, content_limit), "content")


def created(requests: DataFrame, documents: DataFrame, tenants: DataFrame, context: TenantContext, now: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted documents, refused requests). Requests name source, source_id, title, content and metadata.

    An item that has a source_id always gets the same id, so sending it again overwrites.
    """
    if not context.may("EDITOR", "TENANT_ADMIN"):
        return requests.filter("false"), requests.withColumn("reason", F.lit("role"))
    own = tenants.filter(F.col("id") == context.tenant_id)
    full = over_quota(documents.filter(F.col("tenant_id") == context.tenant_id), own).select("rejected")  # one row
    marked = requests.crossJoin(F.broadcast(full)).withColumn("reason", F.coalesce(rejected(F.col("title"), F.col("content")), F.when(F.col("rejected"), "quota"))).drop("rejected")
    key = F.coalesce(F.col("source_id"), F.expr("uuid()"))
    accepted = marked.filter("reason IS NULL").drop("reason").withColumns(
        {
            "doc_id": stable_id(F.lit(context.tenant_id), F.col("source"), key, F.lit(None).cast("string"), F.lit(None).cast("int")),
            "tenant_id": F.lit(context.tenant_id),
            "tier": F.lit(context.tier),
            "status": F.lit("PENDING"),
            "created_at": now,
        }
    )
    return accepted, marked.filter("reason IS NOT NULL")


def events(accepted: DataFrame) -> DataFrame:
    """The indexing event of each accepted document."""
    return accepted.select("doc_id", "tenant_id", "tier", "title", "content", "metadata", F.unix_millis("created_at").alias("created_at"), F.col("source_id").alias("idempotency_key"))


def deleted(documents: DataFrame, chunks: DataFrame, ids: DataFrame, context: TenantContext) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tenant's named documents; chunks go with their document."""
    own = ids.join(documents.filter(F.col("tenant_id") == context.tenant_id).select("doc_id"), "doc_id", "left_semi")
    return without(documents, own, ["doc_id"]), without(chunks, own, ["doc_id"])


SEED_TITLES = ["Quarterly revenue", "Onboarding guide", "Incident report", "Release plan", "Security policy"]


def seed(spark: SparkSession, tenants: list[str]) -> DataFrame:
    """A few documents for each tenant, for demonstrations."""
    rows = [(f"{t}-{i}", t, title, f"{title} of {t}.", {"author": f"user{i}", "tags": "demo"}) for t in tenants for i, title in enumerate(SEED_TITLES)]
    return spark.createDataFrame(rows, "doc_id string, tenant_id string, title string, content string, metadata map<string,string>")
