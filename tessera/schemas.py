"""Tables of the data model, and the small fixed dimensions that rules refer to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TENANT = "id string, name string, tier string, quota_docs long, created_at timestamp"
USER = "id string, tenant_id string, display_name string, email string, roles string"
DOCUMENT = "id string, tenant_id string, title string, content string, metadata map<string,string>, status string, created_at timestamp, updated_at timestamp"
INDEXING_EVENT = "doc_id string, tenant_id string, tier string, title string, content string, metadata map<string,string>, created_at long, idempotency_key string"
CHUNK = (
    "doc_id string, chunk_index int, tenant_id string, title string, chunk_text string, embedding array<float>, metadata map<string,string>, created_at timestamp, embedding_version string"
)
SOURCE_DOCUMENT = "source_id string, source_type string, tenant_id string, doc_id string, last_seen_at timestamp"
ENTITY = "entity_type string, entity_id string, tenant_id string, name string, properties string, created_at timestamp, updated_at timestamp"
RELATIONSHIP = "from_type string, from_id string, relation string, to_type string, to_id string, tenant_id string, properties string, created_at timestamp"
ENVIRONMENT = "struct<k8s_bastion:string,k8s_context:string,k8s_namespace:string,pod_map:map<string,string>,elastic_url:string,elastic_index:string>"
CUSTOMER = f"id string, name string, lifecycle_stage string, products array<string>, notes string, aliases array<string>, environments map<string,{ENVIRONMENT}>"
EVAL_ITEM = "id string, question string, expected_sources array<string>, expected_answer_keywords array<string>, customer string, env string"
LOG_RECORD = "ts timestamp, message string, level string, namespace string, pod string, container string, app string"

# Queries a second and a day of each tier.
TIERS = {"FREE": (10, 1_000), "STANDARD": (100, 50_000), "PREMIUM": (1_000, 1_000_000), "ENTERPRISE": (10_000, 2_147_483_647)}
# Authority of a source; anything else has DEFAULT_AUTHORITY.
AUTHORITY = {
    "warehouse_logs": 1.0,
    "logs": 1.0,
    "deployment_state": 0.9,
    "deployment": 0.9,
    "git": 0.8,
    "code": 0.8,
    "github": 0.8,
    "jira": 0.7,
    "release_notes": 0.6,
    "confluence": 0.5,
}
DEFAULT_AUTHORITY = 0.5
# Places a source may take among the selected chunks; any other source has one.
BUDGET = {"warehouse_logs": 2, "deployment_state": 1, "jira": 1, "git": 1, "confluence": 1}
DEFAULT_BUDGET = 1
LIFECYCLE = ["solution", "dev", "testing", "staging", "prod"]
LIFECYCLE_LABELS = {"solution": "Solution design", "dev": "Development", "testing": "Testing", "staging": "Staging", "prod": "Production"}


def choice(key: Column, values: dict, default) -> Column:
    """A CASE over a small fixed mapping: stays inside generated code, needs no join."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def authority(source: Column) -> Column:
    return choice(F.lower(source), AUTHORITY, DEFAULT_AUTHORITY)


def budget(source: Column) -> Column:
    return choice(source, BUDGET, DEFAULT_BUDGET)


def stage_ordinal(stage: Column) -> Column:
    """1 for the first lifecycle stage, 0 for none of them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LIFECYCLE)), stage), F.lit(0))


def index_name(kind: str, tenant: Column, tier: Column) -> Column:
    """Enterprise tenants have an index of their own, the others share one."""
    return F.when(tier == "ENTERPRISE", F.concat(F.lit(f"{kind}-"), F.lower(tenant))).otherwise(F.lit(f"{kind}-shared"))
