"""The knowledge graph on two tables: upserts, edge extraction, neighbours, bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import pull_request, relation, tickets
from tessera.operators.upsert import first_wins, merged

ENTITY_KEY = ["entity_type", "entity_id", "tenant_id"]
EDGE_KEY = ["from_type", "from_id", "relation", "to_type", "to_id", "tenant_id"]
LEAST_DEPTH, MOST_DEPTH = 1, 5


def upsert_entities(entities: DataFrame, updates: DataFrame) -> DataFrame:
    return merged(entities, updates, ENTITY_KEY, ["updated_at"])


def insert_relationships(edges: DataFrame, additions: DataFrame, order: list[str]) -> DataFrame:
    return first_wins(edges, additions, EDGE_KEY, order)


def entities_of(entities: DataFrame, tenant: str, entity_type: str) -> DataFrame:
    return entities.filter((F.col("tenant_id") == tenant) & (F.col("entity_type") == entity_type))


def neighbours(edges: DataFrame, entities: DataFrame, tenant: str, entity_type: str, entity_id: str) -> DataFrame:
    """(direction, relation, entity_type, entity_id, name) of both directions; name is null where the entity has no row."""
    own = edges.filter(F.col("tenant_id") == tenant)
    outward = own.filter((F.col("from_type") == entity_type) & (F.col("from_id") == entity_id)).select(F.lit("out").alias("direction"), "relation", F.col("to_type").alias("entity_type"), F.col("to_id").alias("entity_id"))
    inward = own.filter((F.col("to_type") == entity_type) & (F.col("to_id") == entity_id)).select(F.lit("in").alias("direction"), "relation", F.col("from_type").alias("entity_type"), F.col("from_id").alias("entity_id"))
    names = entities.filter(F.col("tenant_id") == tenant).select("entity_type", "entity_id", "name")
    return outward.unionByName(inward).join(names, ["entity_type", "entity_id"], "left").select("direction", "relation", "entity_type", "entity_id", "name")


def reach(edges: DataFrame, entities: DataFrame, tenant: str, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start_type, start_id, entity_type, entity_id, name, depth): what outward edges reach from each start (entity_type,
    entity_id), each level once; nodes without a row are passed but not shown.

    A level is an equi-join of the distinct frontier of all starts, so paths do not multiply. The plan is lazy and holds a branch for
    each level; a frontier ends in one exchange, which the level itself and the next one share when it runs.
    """
    depth = max(LEAST_DEPTH, min(depth, MOST_DEPTH))
    own = edges.filter(F.col("tenant_id") == tenant).select(F.col("from_type").alias("entity_type"), F.col("from_id").alias("entity_id"), "to_type", "to_id")
    frontier = starts.select(F.col("entity_type").alias("start_type"), F.col("entity_id").alias("start_id"), "entity_type", "entity_id").distinct()
    reached = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        frontier = own.join(frontier, ["entity_type", "entity_id"]).select("start_type", "start_id", F.col("to_type").alias("entity_type"), F.col("to_id").alias("entity_id")).distinct()
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(level)))
    names = entities.filter(F.col("tenant_id") == tenant).select("entity_type", "entity_id", "name")
    return reached.join(names, ["entity_type", "entity_id"]).select("start_type", "start_id", "entity_type", "entity_id", "name", "depth")


def traverse(edges: DataFrame, entities: DataFrame, tenant: str, entity_type: str, entity_id: str, depth: int = 3) -> DataFrame:
    """(entity_type, entity_id, name, depth): what outward edges reach from one node, see :func:`reach`."""
    start = edges.sparkSession.range(1).select(F.lit(entity_type).alias("entity_type"), F.lit(entity_id).alias("entity_id"))
    return reach(edges, entities, tenant, start, depth).drop("start_type", "start_id")


def grouped_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("entity_type").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"), F.countDistinct("entity_id").alias("n"))


def _edge(from_type: str, from_id: Column, label: Column, to_type: str, to_id: Column) -> list[Column]:
    return [F.lit(from_type).alias("from_type"), from_id.alias("from_id"), label.alias("relation"), F.lit(to_type).alias("to_type"), to_id.alias("to_id")]


def issue_edges(issues: DataFrame) -> DataFrame:
    """Edges of issues (issue_key, remote_links array<struct<url,relationship>>, linked_issues array<struct<key,label>>)."""
    links = issues.select("issue_key", F.explode("remote_links").alias("link")).withColumn("pr", pull_request(F.col("link.url"))).filter("pr IS NOT NULL")
    prs = links.select(*_edge("jira_issue", F.col("issue_key"), relation(F.coalesce("link.relationship", F.lit("links to"))), "pull_request", F.col("pr")))
    own = issues.select("issue_key", F.explode("linked_issues").alias("link")).filter("link.key IS NOT NULL")
    return prs.unionByName(own.select(*_edge("jira_issue", F.col("issue_key"), F.lit("linked_to"), "jira_issue", F.col("link.key")))).distinct()


def pull_request_edges(prs: DataFrame) -> DataFrame:
    """Edges of merged pull requests (repo, number, title, body): to their service and the tickets they name."""
    own = prs.filter("merged_at IS NOT NULL").withColumn("pr", F.concat("repo", F.lit("#"), F.col("number").cast("string")))
    merges = own.select(*_edge("pull_request", F.col("pr"), F.lit("merges_into"), "service", F.col("repo")))
    named = own.select("pr", F.explode(tickets(F.concat_ws(" ", "title", "body"))).alias("ticket"))
    return merges.unionByName(named.select(*_edge("pull_request", F.col("pr"), F.lit("references"), "jira_issue", F.col("ticket")))).distinct()


def deployment_edges(customers: DataFrame, deployments: DataFrame) -> DataFrame:
    """Customer to environment to service, from (id, environments map) and (customer, env, name)."""
    envs = customers.select("id", F.explode(F.map_keys("environments")).alias("env"))
    place = F.concat_ws("/", "id", "env")
    has = envs.select(*_edge("customer", F.col("id"), F.lit("has_env"), "deployment", place))
    runs = deployments.select(*_edge("deployment", F.concat_ws("/", "customer", "env"), F.lit("runs"), "service", F.col("name")))
    return has.unionByName(runs).distinct()


def recursive_traverse_sql(edges: str, entities: str, tenant: str, entity_type: str, entity_id: str, depth: int = 3) -> str:
    """The same traversal as one recursive statement over registered views."""
    depth = max(LEAST_DEPTH, min(depth, MOST_DEPTH))
    return f"""
        WITH RECURSIVE reach(entity_type, entity_id, depth) AS (
            SELECT '{entity_type}', '{entity_id}', 0
            UNION ALL
            SELECT e.to_type, e.to_id, r.depth + 1 FROM reach r JOIN {edges} e ON e.from_type = r.entity_type AND e.from_id = r.entity_id
            WHERE e.tenant_id = '{tenant}' AND r.depth < {depth})
        SELECT DISTINCT r.entity_type, r.entity_id, n.name, r.depth FROM reach r
        JOIN {entities} n ON n.entity_type = r.entity_type AND n.entity_id = r.entity_id AND n.tenant_id = '{tenant}'"""
