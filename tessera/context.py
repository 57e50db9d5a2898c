"""Who asks: every query builder takes a context and applies its filters itself, so no caller can forget them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TenantContext:
    tenant_id: str
    user_id: str = ""
    tier: str = "STANDARD"
    roles: frozenset[str] = field(default_factory=frozenset)

    def may(self, *allowed: str) -> bool:
        return bool(self.roles & set(allowed))


def scoped(df: DataFrame, context: TenantContext, **metadata: str | None) -> DataFrame:
    """Rows of the context's tenant with the given metadata values; blank values are no filter. Goes to the scan."""
    df = df.filter(F.col("tenant_id") == context.tenant_id)
    for key, value in metadata.items():
        if value and value.strip():
            df = df.filter(F.col(key) == value)
    return df


def customer_scoped(df: DataFrame, context: TenantContext, customer: str) -> DataFrame:
    """As :func:`scoped`, but the customer is never optional."""
    return df.filter((F.col("tenant_id") == context.tenant_id) & (F.col("customer") == customer))


def role_array(roles: Column) -> Column:
    return F.filter(F.transform(F.split(roles, ","), lambda r: F.trim(r)), lambda r: r != "")


def role_gate(df: DataFrame, *allowed: str) -> DataFrame:
    return df.filter(F.arrays_overlap(role_array(F.col("roles")), F.array(*map(F.lit, allowed))))


def members(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Users of tenants that exist, with the tenant's tier. Spark broadcasts the tenants while they are small."""
    return users.join(tenants.select(F.col("id").alias("tenant_id"), "tier"), "tenant_id")


def allowed_customer(allowed: Column, customer: Column) -> Column:
    return F.array_contains(allowed, "*") | F.array_contains(allowed, customer)


def known_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose key exists; used before any tool runs."""
    return requests.join(keys.select("api_key"), "api_key", "left_semi")


def masked(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 16), F.lit("..."))


def delete_keys(keys: DataFrame, prefix: str) -> DataFrame:
    """Keys without those that start with the prefix; the last administrator's key stays."""
    hit = F.col("api_key").startswith(prefix)
    admins = keys.agg(F.count_if(F.col("is_admin") & ~hit).alias("left"))
    return keys.crossJoin(F.broadcast(admins)).filter(~hit | ((F.col("left") == 0) & F.col("is_admin"))).drop("left")  # one row


def unknown_references(keys: DataFrame, customers: DataFrame) -> DataFrame:
    """(api_key, customer) of allow-lists that name customers which do not exist."""
    wanted = keys.select("api_key", F.explode("allowed").alias("customer")).filter("customer <> '*'")
    return wanted.join(customers.select(F.col("id").alias("customer")), "customer", "left_anti").select("api_key", "customer")


def over_quota(documents: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants with their document count and whether the next document is refused."""
    counts = documents.groupBy("tenant_id").agg(F.count("*").alias("n_docs"))
    rows = tenants.select(F.col("id").alias("tenant_id"), "quota_docs").join(counts, "tenant_id", "left")
    return rows.select("tenant_id", "quota_docs", F.coalesce("n_docs", F.lit(0)).alias("n_docs")).withColumn("rejected", F.col("n_docs") >= F.col("quota_docs"))


ID_PATTERN = r"^[a-z0-9][a-z0-9-]{1,62}$"


def valid_tenants(requests: DataFrame, tiers: list[str]) -> DataFrame:
    """Requests with ``valid``: the id has the admitted form, the name is not blank and the tier exists."""
    fits = F.col("id").rlike(ID_PATTERN) & (F.trim(F.col("name")) != "") & F.upper("tier").isin(tiers)
    return requests.withColumn("valid", F.coalesce(fits, F.lit(False)))


def create_tenants(tenants: DataFrame, requests: DataFrame, tiers: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(tenants with the valid new ones, refused requests); an id that exists is refused."""
    marked = valid_tenants(requests, tiers).join(tenants.select("id").withColumn("taken", F.lit(True)), "id", "left")
    fits = F.col("valid") & F.col("taken").isNull()
    added = marked.filter(fits).select("id", "name", F.upper("tier").alias("tier"), F.coalesce("quota_docs", F.lit(100_000)).cast("long").alias("quota_docs"), now.alias("created_at"))
    return tenants.unionByName(added), marked.filter(~fits).drop("valid", "taken")
