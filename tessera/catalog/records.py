"""Graph, registry, resolution, logs, limits, sessions, sync, admission, evaluation and state over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.base import AS_OF, DOCS, LOGS, docs, logs, query, table, text, values
from tessera.catalog.texts import HTML
from tessera.functions import similarity
from tessera.functions.text import TICKET, fingerprint
from tessera.operators import evaluate, graph, joins, limits, registry, resolve, sessions, upsert
from tessera.operators import logs as L
from tessera.sources import cache, connectors, retry, state

# --- graph: nations, customers, suppliers and orders ---------------------------------------------------------------

EDGES = """edges AS (
    SELECT 'nation' AS from_type, CAST(n_nationkey AS VARCHAR) AS from_id, 'in_region' AS relation, 'region' AS to_type, CAST(n_regionkey AS VARCHAR) AS to_id, 'acme' AS tenant_id FROM nation
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'in_nation', 'nation', CAST(c_nationkey AS VARCHAR), 'acme' FROM customer
    UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'placed_by', 'customer', CAST(o_custkey AS VARCHAR), 'acme' FROM orders
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'in_nation', 'nation', CAST(s_nationkey AS VARCHAR), 'globex' FROM supplier
    UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 'next_to', 'region', CAST((r_regionkey + 1) % 5 AS VARCHAR), 'acme' FROM region),
 ents AS (SELECT 'nation' AS entity_type, CAST(n_nationkey AS VARCHAR) AS entity_id, 'acme' AS tenant_id, n_name AS name FROM nation
    UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 'acme', r_name FROM region WHERE r_regionkey <> 3
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'acme', c_name FROM customer)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, from_type: str, key: str, label: str, to_type: str, to, tenant: str = "acme") -> DataFrame:
        own = table(spark, sf_dir, name)
        return own.select(F.lit(from_type).alias("from_type"), F.col(key).cast("string").alias("from_id"), F.lit(label).alias("relation"), F.lit(to_type).alias("to_type"), to.cast("string").alias("to_id"), F.lit(tenant).alias("tenant_id"))

    return (
        part("nation", "nation", "n_nationkey", "in_region", "region", F.col("n_regionkey"))
        .unionByName(part("customer", "customer", "c_custkey", "in_nation", "nation", F.col("c_nationkey")))
        .unionByName(part("orders", "order", "o_orderkey", "placed_by", "customer", F.col("o_custkey")))
        .unionByName(part("supplier", "supplier", "s_suppkey", "in_nation", "nation", F.col("s_nationkey"), "globex"))
        .unionByName(part("region", "region", "r_regionkey", "next_to", "region", (F.col("r_regionkey") + 1) % 5))
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, kind: str, key: str, label: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.lit("acme").alias("tenant_id"), F.col(label).alias("name"))

    regions = part("region", "region", "r_regionkey", "r_name").filter("entity_id <> '3'")
    return part("nation", "nation", "n_nationkey", "n_name").unionByName(regions).unionByName(part("customer", "customer", "c_custkey", "c_name"))


@query(
    "kg_neighbors",
    f"""WITH {EDGES}, n AS (SELECT 'out' AS direction, relation, to_type AS entity_type, to_id AS entity_id FROM edges WHERE tenant_id = 'acme' AND from_type = 'nation' AND from_id = '7'
    UNION ALL SELECT 'in', relation, from_type, from_id FROM edges WHERE tenant_id = 'acme' AND to_type = 'nation' AND to_id = '7')
    SELECT direction, relation, n.entity_type, n.entity_id, name FROM n LEFT JOIN ents e ON e.entity_type = n.entity_type AND e.entity_id = n.entity_id""",
)
def kg_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir), entities(spark, sf_dir), "acme", "nation", "7")


TRAVERSE = f"""WITH RECURSIVE {EDGES}, reach(t, i, d) AS (SELECT 'order', '1', 0 UNION ALL SELECT to_type, to_id, d + 1 FROM reach JOIN edges ON from_type = t AND from_id = i WHERE tenant_id = 'acme' AND d < 5)
 SELECT DISTINCT t AS entity_type, i AS entity_id, name, d AS depth FROM reach JOIN ents ON entity_type = t AND entity_id = i"""


@query("kg_traverse", TRAVERSE)
def kg_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(edges(spark, sf_dir), entities(spark, sf_dir), "acme", "order", "1", 9)


@query(
    "kg_reach",
    f"""WITH RECURSIVE {EDGES}, reach(s, t, i, d) AS (SELECT i, t, i, 0 FROM (SELECT 'customer' AS t, CAST(c_custkey AS VARCHAR) AS i FROM customer) UNION ALL SELECT s, to_type, to_id, d + 1 FROM reach JOIN edges ON from_type = t AND from_id = i WHERE tenant_id = 'acme' AND d < 3)
    SELECT DISTINCT 'customer' AS start_type, s AS start_id, t AS entity_type, i AS entity_id, name, d AS depth FROM reach JOIN ents ON entity_type = t AND entity_id = i""",
)
def kg_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer leads to, in one plan."""
    own = entities(spark, sf_dir)
    return graph.reach(edges(spark, sf_dir), own, "acme", own.filter("entity_type = 'customer'"))


@query("kg_traverse_recursive", TRAVERSE)
def kg_traverse_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges(spark, sf_dir).createOrReplaceTempView("kg_edges_view")
    entities(spark, sf_dir).createOrReplaceTempView("kg_entities_view")
    return spark.sql(graph.recursive_traverse_sql("kg_edges_view", "kg_entities_view", "acme", "order", "1", 5))


@query("kg_entities", f"WITH {EDGES} SELECT entity_id, name FROM ents WHERE entity_type = 'nation'")
def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities_of(entities(spark, sf_dir), "acme", "nation").select("entity_id", "name")


@query("kg_grouped", f"WITH {EDGES} SELECT entity_type, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS ids, count(DISTINCT entity_id) AS n FROM ents GROUP BY entity_type")
def kg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.grouped_by_type(entities(spark, sf_dir)).select("entity_type", F.array_join("ids", ",").alias("ids"), "n")


@query(
    "kg_entity_upsert",
    "SELECT 'customer' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, 'acme' AS tenant_id, arg_max(event_type || event_id, (ts, event_id)) AS name FROM events GROUP BY user_id",
)
def kg_entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.lit("customer").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.lit("acme").alias("tenant_id"), F.concat("event_type", F.col("event_id").cast("string")).alias("name"), F.struct("ts", "event_id").alias("updated_at")
    )
    return graph.upsert_entities(rows.filter("name LIKE 'click%'"), rows.filter("name NOT LIKE 'click%'")).drop("updated_at")


@query("kg_edge_dedup", "SELECT 'user' AS from_type, CAST(user_id AS VARCHAR) AS from_id, event_type AS relation, 'event' AS to_type, 'x' AS to_id, 'acme' AS tenant_id, min(event_id) AS seen FROM events GROUP BY user_id, event_type")
def kg_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.lit("user").alias("from_type"), F.col("user_id").cast("string").alias("from_id"), F.col("event_type").alias("relation"), F.lit("event").alias("to_type"), F.lit("x").alias("to_id"), F.lit("acme").alias("tenant_id"), F.col("event_id").alias("seen")
    )
    return graph.insert_relationships(rows.filter("false"), rows, ["seen"])


PULLS = f"""prs AS (SELECT source AS repo, CAST(doc_id AS INTEGER) AS number, concat('GM-', doc_id % 7, ': fix ', coalesce(text, '')) AS named,
    CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 91 AS INTEGER)) END AS merged_at FROM documents)"""


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        F.col("source").alias("repo"), F.col("doc_id").cast("int").alias("number"), F.expr("concat('GM-', doc_id % 7, ': fix')").alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.when(F.col("doc_id") % 3 != 0, F.col("created_at")).alias("merged_at")
    )


@query(
    "kg_pr_edges",
    f"""WITH {PULLS}, m AS (SELECT repo, repo || '#' || number AS pr, named FROM prs WHERE merged_at IS NOT NULL)
    SELECT DISTINCT 'pull_request' AS from_type, pr AS from_id, 'merges_into' AS relation, 'service' AS to_type, repo AS to_id FROM m
    UNION ALL SELECT DISTINCT 'pull_request', pr, 'references', 'jira_issue', unnest(regexp_extract_all(named, {text(TICKET)}, 1)) FROM m""",
)
def kg_pr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pull_request_edges(pulls(spark, sf_dir))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues with links, custom fields and a rich description."""
    url = "CASE event_id % 3 WHEN 0 THEN concat('https://github.com/o/repo', user_id, '/pull/', event_id) WHEN 1 THEN 'https://example.com' END"
    label = "CASE event_id % 4 WHEN 0 THEN 'is Fixed by' WHEN 1 THEN 'mentions' END"
    tree = "concat('{\"type\":\"doc\",\"content\":[{\"type\":\"paragraph\",\"content\":[{\"type\":\"text\",\"text\":\"It is ', event_type, '\"}]}]}')"
    return table(spark, sf_dir, "events").select(
        F.expr("concat('E-', event_id)").alias("issue_key"),
        F.col("event_type").alias("summary"),
        F.expr(tree).alias("description"),
        F.expr("CASE WHEN event_id % 5 <> 0 THEN 'Open' END").alias("status"),
        F.expr("concat('P', user_id % 4)").alias("priority"),
        F.col("ts").cast("timestamp").alias("updated"),
        F.expr("map('f1', array(event_type), 'f2', array(concat('u', user_id), 'b'), 'f3', CASE WHEN event_id % 2 = 0 THEN array('even') ELSE cast(array() AS array<string>) END, 'rank', array('x'))").alias("fields"),
        F.expr(f"array(named_struct('url', {url}, 'relationship', {label}))").alias("remote_links"),
        F.expr("array(named_struct('key', CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('E-', user_id) END, 'label', 'blocks'))").alias("linked_issues"),
    )


@query(
    "kg_issue_edges",
    """SELECT DISTINCT 'jira_issue' AS from_type, concat('E-', event_id) AS from_id, CASE WHEN event_id % 4 = 0 THEN 'fixed_by' ELSE 'linked_to' END AS relation, 'pull_request' AS to_type, concat('repo', user_id, '#', event_id) AS to_id FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT DISTINCT 'jira_issue', concat('E-', event_id), 'linked_to', 'jira_issue', concat('E-', user_id) FROM events WHERE event_id % 7 <> 0""",
)
def kg_issue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.issue_edges(issues(spark, sf_dir))


#: Parts as tab-separated deployment lines; some have no image, some no pods.
LINE = "concat('svc-', cast(p_partkey AS varchar(20)), CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat(chr(9), 'r/', p_brand, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(':v', cast(p_size AS varchar(9))) END) END, CASE WHEN p_partkey % 9 < 2 THEN '' ELSE concat(chr(9), cast(p_size % 4 AS varchar(9)), '/3') END)"
DEPLOYED = f"""lines AS (SELECT concat('c', p_size % 10) AS customer, CASE WHEN p_partkey % 2 = 0 THEN 'prod' ELSE 'dev' END AS env, string_split({LINE}, chr(9)) AS f FROM part),
    deployed AS (SELECT customer, env, f[1] AS name, CASE WHEN contains(f[2], ':') THEN string_split(f[2], ':')[-1] ELSE 'unknown' END AS version, coalesce(f[3], '?/?') AS pods FROM lines WHERE len(f) >= 2)"""


def deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.deployments(table(spark, sf_dir, "part").select(F.expr("concat('c', p_size % 10)").alias("customer"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'prod' ELSE 'dev' END").alias("env"), F.expr(LINE).alias("line")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of customers as a registry."""
    none = "cast(map() AS map<string,map<string,string>>)"
    return table(spark, sf_dir, "customer").select(
        F.expr("concat('c', c_custkey)").alias("id"),
        F.col("c_name").alias("name"),
        F.expr("element_at(array('solution', 'dev', 'testing', 'staging', 'prod'), cast(c_custkey % 5 + 1 AS int))").alias("lifecycle_stage"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN cast(array() AS array<string>) ELSE array(lower(c_mktsegment), concat('p', c_custkey % 3)) END").alias("products"),
        F.lit("").alias("notes"),
        F.expr("CASE WHEN c_custkey % 3 <> 0 THEN array(c_mktsegment) END").alias("aliases"),
        F.expr(f"CASE c_custkey % 3 WHEN 0 THEN {none} WHEN 1 THEN map('dev', map('k8s_namespace', 'd')) ELSE map('dev', map('k8s_namespace', 'd'), 'prod', map('k8s_namespace', 'p')) END").alias("environments"),
        F.col("c_custkey").cast("int").alias("position"),
    )


#: The same registry in DuckDB: k numbers the customers, stages count from 0.
REGISTRY = "r AS (SELECT c_custkey AS k, concat('c', c_custkey) AS id, c_name AS name, c_mktsegment AS segment, CAST(c_custkey % 5 AS INTEGER) AS stage FROM customer)"
STAGE_NAMES = "['solution', 'dev', 'testing', 'staging', 'prod']"


@query(
    "kg_deployment_edges",
    f"""WITH {REGISTRY}, {DEPLOYED}, envs AS (SELECT id, 'dev' AS env FROM r WHERE k % 3 <> 0 UNION ALL SELECT id, 'prod' FROM r WHERE k % 3 = 2)
    SELECT 'customer' AS from_type, id AS from_id, 'has_env' AS relation, 'deployment' AS to_type, id || '/' || env AS to_id FROM envs
    UNION ALL SELECT DISTINCT 'deployment', customer || '/' || env, 'runs', 'service', name FROM deployed""",
)
def kg_deployment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.deployment_edges(customers(spark, sf_dir), deployed(spark, sf_dir))


# --- registry and resolution ------------------------------------------------------------------------------------------


@query(
    "registry_update",
    f"""WITH {REGISTRY} SELECT id, CASE WHEN k % 4 = 0 THEN concat('N', k) ELSE name END AS name, CASE WHEN k % 6 = 0 THEN 'testing' ELSE {STAGE_NAMES}[stage + 1] END AS lifecycle_stage FROM r""",
)
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir)
    changes = own.filter("position % 2 = 0").select("id", F.expr("CASE WHEN position % 4 = 0 THEN concat('N', position) END").alias("name"), F.expr("CASE WHEN position % 3 = 0 THEN 'testing' END").alias("lifecycle_stage"))
    return registry.update(own, changes).select("id", "name", "lifecycle_stage")


@query(
    "registry_environments",
    f"""WITH {REGISTRY}, u AS (SELECT id, k, stage, k % 2 = 0 AS fresh, CASE WHEN k % 5 <> 0 THEN concat('ns-', k) END AS given, CASE WHEN k % 3 = 0 THEN 3 ELSE 4 END AS env FROM r)
    SELECT id, {STAGE_NAMES}[CASE WHEN fresh THEN greatest(stage, env) ELSE stage END + 1] AS lifecycle_stage,
    CASE WHEN fresh THEN coalesce(given, CASE WHEN k % 3 = 2 THEN 'p' END) ELSE CASE k % 3 WHEN 1 THEN 'd' WHEN 2 THEN 'p' END END AS namespace,
    CASE WHEN fresh THEN {STAGE_NAMES}[env + 1] ELSE CASE k % 3 WHEN 1 THEN 'dev' WHEN 2 THEN 'prod' END END AS best_env FROM u""",
)
def registry_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir)
    settings = F.expr("map('k8s_namespace', CASE WHEN position % 5 = 0 THEN '' ELSE concat('ns-', position) END, 'k8s_context', '')")
    updates = own.filter("position % 2 = 0").select("id", F.expr("CASE WHEN position % 3 = 0 THEN 'staging' ELSE 'prod' END").alias("env"), settings.alias("settings"))
    out = registry.upsert_environments(own, updates)
    best = registry.resolved_environment(F.col("environments"), F.lit("qa"))
    return out.select("id", "lifecycle_stage", F.try_element_at(F.try_element_at("environments", best), F.lit("k8s_namespace")).alias("namespace"), best.alias("best_env"))


@query(
    "registry_listing",
    f"""WITH {REGISTRY}, e AS (SELECT id, CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['dev'] ELSE ['dev', 'prod'] END AS own FROM r)
    SELECT id, array_to_string(own, ',') AS configured, array_to_string(list_filter({STAGE_NAMES}[2:], lambda x: NOT list_contains(own, x)), ',') AS missing FROM e""",
)
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.environment_listing(customers(spark, sf_dir)).select("id", F.array_join("configured", ",").alias("configured"), F.array_join("missing", ",").alias("missing"))


@query("registry_create_delete", f"WITH {REGISTRY} SELECT id FROM r WHERE (k % 3 <> 0 OR k % 2 = 0) AND k NOT IN (SELECT s_suppkey FROM supplier)")
def registry_create_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    gone = table(spark, sf_dir, "supplier").select(F.expr("concat('c', s_suppkey)").alias("id"))
    return registry.delete(registry.create(rows.filter("position % 3 <> 0"), rows.filter("position % 2 = 0")), gone).select("id")


@query("registry_products", f"WITH {REGISTRY} SELECT id, concat(CASE WHEN lower(segment) IN ('building', 'machinery') THEN '' ELSE lower(segment) || CASE WHEN k % 3 = 1 THEN '' ELSE ',' END END, CASE WHEN k % 3 = 1 THEN '' ELSE concat('p', k % 3) END) AS unknown FROM r WHERE k % 4 <> 0 AND (lower(segment) NOT IN ('building', 'machinery') OR k % 3 <> 1)")
def registry_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.unknown_products(customers(spark, sf_dir), ["building", "machinery", "p1"]).select("id", F.array_join("unknown", ",").alias("unknown"))


@query(
    "registry_normalise",
    f"""WITH {REGISTRY}, f AS (SELECT *, CASE WHEN k % 5 < 2 THEN 'prod' ELSE 'dev' END AS env FROM r)
    SELECT id, CASE WHEN k % 4 = 0 THEN id ELSE name END AS name, CASE WHEN k % 3 = 0 THEN env ELSE 'testing' END AS lifecycle_stage, env, CASE WHEN k % 2 = 0 THEN concat('ns', k) END AS namespace FROM f""",
)
def registry_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = customers(spark, sf_dir).select(
        "id",
        F.expr("CASE WHEN position % 4 <> 0 THEN name END").alias("name"),
        F.expr("CASE WHEN position % 3 <> 0 THEN 'testing' END").alias("lifecycle_stage"),
        F.expr("CASE position % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'dev' END").alias("env"),
        F.expr("CASE WHEN position % 2 = 0 THEN concat('ns', position) ELSE '' END").alias("k8s_namespace"),
    )
    out = registry.normalised(flat)
    env = F.get(F.map_keys("environments"), F.lit(0))
    return out.select("id", "name", "lifecycle_stage", env.alias("env"), F.try_element_at(F.try_element_at("environments", env), F.lit("k8s_namespace")).alias("namespace"))


@query(
    "alias_learn",
    f"""WITH {REGISTRY}, p AS (SELECT id, CASE WHEN k % 3 <> 0 THEN [segment] ELSE [] END AS own, CASE k % 4 WHEN 0 THEN lower(segment) || '. ' WHEN 1 THEN 'New Name' WHEN 2 THEN ' ! ' ELSE segment END AS phrase FROM r),
    n AS (SELECT *, trim(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g')) AS plain FROM p)
    SELECT id, array_to_string(CASE WHEN plain = '' OR list_contains(list_transform(own, lambda a: lower(a)), plain) THEN own ELSE list_append(own, phrase) END, '|') AS aliases FROM n""",
)
def alias_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("position"), "c_mktsegment"), "position")
    phrase = F.expr("CASE position % 4 WHEN 0 THEN concat(lower(c_mktsegment), '. ') WHEN 1 THEN 'New Name' WHEN 2 THEN ' ! ' ELSE c_mktsegment END")
    return rows.select("id", F.array_join(registry.learned_alias(F.col("aliases"), phrase), "|").alias("aliases"))


#: The customers that the questions name.
NAMED = [("acme", "Acme Corp", ["ACME Inc", "acme!"], 0), ("globex", "Globex", None, 1), ("initech", "Initech", [], 2)]


@query("customer_resolve")
def customer_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.catalog.texts import asked

    questions = asked(spark, sf_dir).select(F.col("id").alias("question_id"), F.col("q").alias("question"), F.lit(None).cast("string").alias("hint"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n-"), F.lower("n_name")).alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("the "), "n_name")).alias("aliases"), (F.col("n_nationkey") + 10).cast("int").alias("position"))
    registry = nations.unionByName(spark.createDataFrame(NAMED, "id string, name string, aliases array<string>, position int"))
    return resolve.resolved(questions, resolve.scored(questions, registry))


@query(
    "jaccard_match",
    """WITH c AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM customer), s AS (SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM supplier),
    p AS (SELECT c_custkey, s_suppkey, list_distinct(string_split(c.n, ' ')) AS a, list_distinct(string_split(s.n, ' ')) AS b FROM c JOIN s ON len(list_intersect(string_split(c.n, ' '), string_split(s.n, ' '))) > 0)
    SELECT c_custkey AS question_id, s_suppkey AS customer_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM p WHERE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) >= 0.3""",
)
def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_name").alias("question"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return resolve.token_matches(left, right)


@query("matching_ratio")
def matching_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer")
    return names.select("c_custkey", F.round(similarity.matching_ratio(F.col("c_name"), F.lower("c_mktsegment")), 6).alias("ratio"))


# --- logs --------------------------------------------------------------------------------------------------------------

LOG_FILTER = f"ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 600 MINUTES AND TIMESTAMP '2024-01-20 12:00:00'"
LOG_AS_OF = "2024-01-20 12:00:00"


def _as_of(value: str = LOG_AS_OF):
    return F.lit(value).cast("timestamp")


@query("log_query", f"WITH {LOGS} SELECT event_id, level, pod FROM logs WHERE {LOG_FILTER} AND namespace = 'ns-1' AND level = 'ERROR' ORDER BY ts DESC, event_id LIMIT 300")
def log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(L.matching(logs(spark, sf_dir), _as_of(), 600, namespace="ns-1", level="error")).select("event_id", "level", "pod")


@query("log_prefix", f"WITH {LOGS} SELECT event_id FROM logs WHERE {LOG_FILTER} AND starts_with(pod, 'svc-4')")
def log_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.matching(logs(spark, sf_dir), _as_of(), 600, service="svc-4").select("event_id")


@query("log_grep_and", f"WITH {LOGS} SELECT event_id FROM logs WHERE {LOG_FILTER} AND len(list_filter(['click', 'k'], lambda t: NOT list_contains(regexp_extract_all(lower(message), '[\\p{{L}}\\p{{N}}]+'), t))) = 0")
def log_grep_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.matching(logs(spark, sf_dir), _as_of(), 600, grep="Click k").select("event_id")


@query("log_relax", f"WITH {LOGS} SELECT event_id FROM logs WHERE {LOG_FILTER} AND level = 'ERROR'")
def log_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.relaxed(logs(spark, sf_dir), _as_of(), "no-such-namespace", minutes=600, level="ERROR").select("event_id")


@query("log_tail", f"WITH {LOGS}, p AS (SELECT DISTINCT pod FROM logs WHERE starts_with(pod, 'svc-1') ORDER BY pod LIMIT 3) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY pod ORDER BY ts DESC, event_id DESC) AS n FROM logs JOIN p USING (pod)) WHERE n <= 50 AND contains(lower(message), 'click') ORDER BY ts DESC, event_id DESC LIMIT 400")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tail(logs(spark, sf_dir), "svc-1", lines=50, grep="CLICK").select("event_id")


@query("log_lines", f"WITH {LOGS} SELECT event_id, concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), '[' || level || ']', pod, message) AS line FROM logs")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir)
    from tessera.functions.text import log_line

    return rows.select("event_id", log_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("level"), F.col("pod"), F.col("message")).alias("line"))


@query("log_indices", f"WITH {LOGS} SELECT namespace AS index_name, count(*) AS docs, CAST(sum(length(message)) AS BIGINT) AS bytes FROM logs GROUP BY namespace")
def log_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.indices(logs(spark, sf_dir).withColumnRenamed("namespace", "index_name"))


@query("log_renamed", f"WITH {LOGS} SELECT event_id, message FROM logs WHERE level = 'ERROR'")
def log_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = logs(spark, sf_dir).withColumnsRenamed({"message": "msg", "level": "severity"})
    return L.renamed(odd, {"message": "msg", "level": "severity"}).filter("level = 'ERROR'").select("event_id", "message")


@query("deployment_state", f"WITH {DEPLOYED} SELECT customer, name, version, TRY_CAST(string_split(pods, '/')[1] AS INTEGER) AS ready, TRY_CAST(string_split(pods, '/')[2] AS INTEGER) AS desired FROM deployed")
def deployment_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deployed(spark, sf_dir).select("customer", "name", "version", "ready", "desired")


@query(
    "deployment_summary",
    f"""WITH {DEPLOYED} SELECT customer, env, 'Customer: ' || customer || chr(10) || 'Environment: ' || env || chr(10) || chr(10) || 'DEPLOYED VERSIONS:' || chr(10)
    || string_agg('  ' || name || ': ' || version || '  (' || pods || ' pods)', chr(10) ORDER BY name) AS content FROM deployed GROUP BY customer, env""",
)
def deployment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.deployment_summary(deployed(spark, sf_dir))


POD = "CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE concat('web-', cast(event_id AS varchar(20)), CASE WHEN event_id % 2 = 0 THEN '   ' ELSE ' ' END, '1/1  ', CASE event_id % 4 WHEN 0 THEN 'CrashLoopBackOff' WHEN 1 THEN 'Pending' ELSE 'Running' END, ' ', cast(user_id % 12 AS varchar(20))) END"


@query(
    "unhealthy",
    f"""WITH p AS (SELECT string_split_regex({POD}, '\\s+') AS f FROM events) SELECT f[1] AS name, f[3] AS status, CAST(f[4] AS INTEGER) AS restarts FROM p
    WHERE len(f) >= 4 AND (f[3] <> 'Running' OR CAST(f[4] AS INTEGER) > 5)""",
)
def unhealthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.expr(POD).alias("line"))
    return L.unhealthy(L.pods(lines)).select("name", "status", "restarts")


# --- limits and sessions -------------------------------------------------------------------------------------------------


@query("rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS rate FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.raw_rate(table(spark, sf_dir, "events"), 60_000).select("event_id", "rate")


#: Requests of each user in order, for folds in SQL.
ORDERED = "e AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events)"
USERS = "(SELECT DISTINCT user_id FROM events)"
FOLLOWS = "a JOIN e ON e.user_id IS NOT DISTINCT FROM a.user_id AND e.i = a.i + 1"
ADMISSION = f"""WITH RECURSIVE {ORDERED},
    a(user_id, i, event_id, held, admitted) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), false FROM {USERS} UNION ALL
      SELECT user_id, i, event_id, CASE WHEN len(kept) < 2 THEN list_append(kept, ms) ELSE kept END, len(kept) < 2
      FROM (SELECT e.user_id, e.i, e.event_id, e.ms, list_filter(a.held, lambda x: x > e.ms - 3600000) AS kept FROM {FOLLOWS}))
    SELECT user_id, event_id, admitted FROM a WHERE i > 0"""


@query("rate_admission", ADMISSION)
def rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.sliding_admission(table(spark, sf_dir, "events"), 2, 3_600_000)


@query("rate_admission_unlimited", "SELECT user_id, event_id, true AS admitted FROM events")
def rate_admission_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.sliding_admission(table(spark, sf_dir, "events"), 1 << 31)


@query(
    "token_bucket",
    f"""WITH RECURSIVE {ORDERED},
    a(user_id, i, event_id, ms, tokens, admitted) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(3 AS DOUBLE), false FROM {USERS} UNION ALL
      SELECT user_id, i, event_id, ms, CASE WHEN now < 1 THEN now ELSE now - 1 END, now >= 1
      FROM (SELECT e.user_id, e.i, e.event_id, e.ms, CASE WHEN a.ms IS NULL THEN a.tokens ELSE least(CAST(3 AS DOUBLE), a.tokens + greatest(0, e.ms - a.ms) * CAST(0.0005 AS DOUBLE) / 1000) END AS now FROM {FOLLOWS}))
    SELECT user_id, event_id, admitted FROM a WHERE i > 0""",
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.bucket_admission(table(spark, sf_dir, "events"), 0.0005, 3)


@query(
    "circuit_breaker",
    f"""WITH RECURSIVE {ORDERED},
    a(user_id, i, event_id, calls, opened, trial, state) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS INTEGER[]), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER[]), '' FROM {USERS} UNION ALL
      SELECT user_id, i, event_id, CASE state WHEN 'rejected' THEN calls WHEN 'half_open' THEN CASE WHEN len(tried) = 3 THEN [] ELSE calls END ELSE CASE WHEN trips THEN [] ELSE known END END,
        CASE state WHEN 'rejected' THEN opened WHEN 'half_open' THEN CASE WHEN len(tried) = 3 AND list_sum(tried) >= 1.5 THEN ms END ELSE CASE WHEN trips THEN ms END END,
        CASE WHEN state = 'half_open' AND len(tried) < 3 THEN tried END, state
      FROM (SELECT *, len(known) >= 10 AND list_sum(known) >= 0.5 * len(known) AS trips, CASE WHEN opened IS NOT NULL AND ms - opened < 3600000 THEN 'rejected' WHEN tried IS NOT NULL THEN 'half_open' ELSE 'closed' END AS state
        FROM (SELECT e.user_id, e.i, e.event_id, e.ms, a.calls, a.opened, list_append(a.calls, fails)[-10:] AS known, CASE WHEN a.opened IS NOT NULL THEN [fails] WHEN a.trial IS NOT NULL THEN list_append(a.trial, fails) END AS tried
          FROM a JOIN (SELECT *, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS fails FROM e) e ON e.user_id IS NOT DISTINCT FROM a.user_id AND e.i = a.i + 1)))
    SELECT user_id, event_id, state FROM a WHERE i > 0""",
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type").isin("error", "click"))
    return limits.breaker_states(calls, "failed", open_ms=3_600_000)


SPLIT = "s AS (SELECT user_id, event_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000 THEN 1 ELSE 0 END AS n FROM events))"


@query("session_split", f"WITH {SPLIT} SELECT event_id, CAST(session_no AS BIGINT) AS session_no FROM s")
def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.split_sessions(table(spark, sf_dir, "events")).select("event_id", "session_no")


@query("session_windows", f"WITH {SPLIT} SELECT user_id, min(ts) AS started, max(ts) AS last_active, count(*) AS n FROM s GROUP BY user_id, session_no")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_windows(table(spark, sf_dir, "events"))


@query("history_tail", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("compress_due", "SELECT conv_id, count(*) AS turns, count(*) >= 6 AS due, CASE WHEN count(*) >= 6 THEN count(*) - 5 ELSE 0 END AS to_compress FROM conversations GROUP BY conv_id")
def compress_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.compression_due(table(spark, sf_dir, "conversations"), at=6)


@query(
    "memory_merge",
    """WITH m AS (SELECT event_id, event_type, user_id, [concat('f', user_id % 5), concat('f', event_id % 5), 'c', 'c', concat('f', event_id % 4)] AS l FROM events),
    d AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS f FROM m)
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat('u', user_id) END AS customer, CASE WHEN event_id % 3 = 0 THEN 'dev' ELSE 'prod' END AS env, array_to_string(f[-3:], ',') AS findings FROM d""",
)
def memory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    old = F.expr("map('customer', event_type, 'env', 'dev')")
    new = F.expr("map('customer', CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('u', user_id) END, 'env', CASE WHEN event_id % 3 = 0 THEN '' ELSE 'prod' END)")
    findings = sessions.merged_findings(F.expr("array(concat('f', user_id % 5), concat('f', event_id % 5), 'c')"), F.expr("array('c', concat('f', event_id % 4))"), 3)
    memory = sessions.merged_memory(old, new)
    return rows.select("event_id", memory["customer"].alias("customer"), memory["env"].alias("env"), F.array_join(findings, ",").alias("findings"))


# --- sync, upserts and purge ---------------------------------------------------------------------------------------------


@query("batch_dedup_latest", "SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY user_id")
def batch_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(
    "upsert_merge",
    "WITH u AS (SELECT doc_id, text, lang, 0 AS v FROM documents UNION ALL SELECT doc_id, 'new ' || lang, 'xx', 1 FROM documents WHERE source = 'src3' UNION ALL SELECT -1, 'added', 'xx', 1) SELECT doc_id, lang, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) AS n FROM u) WHERE n = 1",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.lit(0).alias("v"))
    fresh = table(spark, sf_dir, "documents").filter("source = 'src3'").select("doc_id", F.concat(F.lit("new "), "lang").alias("text"), F.lit("xx").alias("lang"), F.lit(1).alias("v"))
    added = spark.createDataFrame([(-1, "added", "xx", 1)], "doc_id long, text string, lang string, v int")
    return upsert.merged(own, fresh.unionByName(added), ["doc_id"], ["v"]).select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("tombstones", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


FP = "sha256(lower(regexp_replace(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) || chr(10) || chr(10) || lower(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')))"


@query("changed_docs_anti", f"WITH {DOCS} SELECT doc_id, {FP} AS fingerprint FROM docs WHERE source = 'src3' OR doc_id NOT IN (SELECT doc_id FROM labels)")
def changed_docs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).select("doc_id", "title", F.col("text").alias("content"), "source")
    known = own.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    stored = known.select("doc_id", F.when(F.col("source") == "src3", "old").otherwise(fingerprint(F.col("title"), F.col("content"))).alias("fingerprint"))
    return upsert.changed(own, stored).select("doc_id", "fingerprint")


@query("work_list", "SELECT source AS key, CAST(max(doc_id) AS VARCHAR) AS sha FROM documents WHERE source <> 'src3' GROUP BY source")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("key")).agg(F.max("doc_id").cast("string").alias("sha"))
    return upsert.work_list(remote, remote.filter("key = 'src3'"))


@query("stale_purge", f"WITH {DOCS} SELECT doc_id FROM docs WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00'")
def stale_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir)
    tracking = own.select("doc_id", F.col("created_at").alias("last_seen_at"))
    return upsert.purge(own, own, tracking, F.lit("2024-01-01").cast("timestamp"), full_sync=True)[0].select("doc_id")


@query("stale_purge_delta", "SELECT doc_id FROM documents")
def stale_purge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir)
    return upsert.purge(own, own, own.withColumn("last_seen_at", F.col("created_at")), F.lit(AS_OF).cast("timestamp"), full_sync=False)[0].select("doc_id")


@query("watermark_delta", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 300 SECONDS")
def watermark_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.delta(table(spark, sf_dir, "events").withColumn("updated", F.col("ts").cast("timestamp")), _as_of(), 300).select("event_id")


@query("document_status", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'INDEXED' ELSE 'PENDING' END AS status FROM documents")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.document_status(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "status")


@query("surplus_chunks", "SELECT o_custkey AS doc_id, CAST(n AS INTEGER) AS chunk_index FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE n > 2 AND c > 0")
def surplus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), place.alias("chunk_index"))
    return upsert.surplus_chunks(own, own.filter("chunk_index <= 2")).select("doc_id", "chunk_index")


@query("stable_ids", f"WITH {DOCS} SELECT doc_id, sha256(concat_ws(chr(1), tenant_id, source_type, source, '', CAST(doc_id AS VARCHAR))) AS id FROM docs")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", upsert.stable_id(F.col("tenant_id"), F.col("source_type"), F.col("source"), F.lit(None).cast("string"), F.col("doc_id")).alias("id"))


@query(
    "sync_state",
    """SELECT concat('git:', c_custkey) AS key, c_name AS value FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT concat('git:', c_custkey * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END), c_mktsegment FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT concat('git:', c_custkey), c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1""",
)
def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    changes = rows.filter("c_custkey % 3 = 0").select(F.expr("concat('git:', c_custkey * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END)").alias("key"), F.col("c_mktsegment").alias("value"))
    return state.updated(rows.select(F.expr("concat('git:', c_custkey)").alias("key"), F.col("c_name").alias("value")), changes)


@query("scheduler_due", "SELECT event_id AS job, 1705752000 - CAST(floor(epoch(ts)) AS BIGINT) >= user_id * 3600 AS due FROM events")
def scheduler_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("last"), (F.col("user_id") * 3600).alias("every"))
    return state.due(jobs, 1705752000)


@query("query_cache", "SELECT event_id AS key, props AS response FROM events WHERE event_type <> 'click' AND 1705752000 - CAST(floor(epoch(ts)) AS BIGINT) < 86400")
def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("tenant_id"), F.col("props").alias("response"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("stored_at"))
    return cache.lookup(cache.invalidated(rows, "click"), 1705752000, 86_400).select("key", "response")


@query("cached_rows", "SELECT user_id, count(*) AS n FROM events WHERE epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(ts) < 86400 AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id")
def cached_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("stored_at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).filter("ts <= timestamp_ntz'2024-01-20 12:00:00'")
    return cache.lookup(rows, 1705752000, 86_400).groupBy("user_id").agg(F.count("*").alias("n"))


# --- retries ---------------------------------------------------------------------------------------------------------------

ERRORS = "SELECT event_id, user_id % 5 AS retry_count, ts FROM events WHERE event_type = 'error'"


@query(
    "retry_route",
    f"""WITH e AS ({ERRORS}) SELECT event_id, CASE WHEN retry_count + 1 > 3 THEN 'dlq' ELSE 'retry-' || (retry_count + 1) END AS target, CASE WHEN retry_count + 1 > 3 THEN retry_count ELSE retry_count + 1 END AS retry_count,
    CASE WHEN retry_count + 1 <= 3 THEN epoch_ms(TIMESTAMP '{AS_OF}') + CASE retry_count + 1 WHEN 1 THEN 300000 WHEN 2 THEN 1800000 ELSE 7200000 END END AS retry_after FROM e""",
)
def retry_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", (F.col("user_id") % 5).alias("retry_count"))
    return retry.routed(failed, F.unix_millis(F.lit(AS_OF).cast("timestamp"))).select("event_id", "target", "retry_count", "retry_after")


@query("delay_gate", "SELECT event_id, epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-20 12:00:00') <= 30000 AS ready FROM events")
def delay_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("retry_after", F.unix_millis(F.col("ts").cast("timestamp")))
    return rows.select("event_id", retry.ready(F.col("retry_after"), F.unix_millis(_as_of())).alias("ready"))


@query(
    "header_clean",
    """SELECT event_id, concat('a=', event_type, CASE WHEN event_id % 2 = 0 THEN concat(',b=', user_id) ELSE '' END) AS headers, CASE WHEN event_id % 3 = 0 THEN concat('first-', user_id) ELSE event_type END AS original FROM events""",
)
def header_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.create_map(F.lit("a"), F.col("event_type"), F.lit("Retry-Count"), F.lit("2"), F.lit("retry-after"), F.lit("9"))
    second = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    first = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("original-topic"), F.concat(F.lit("first-"), F.col("user_id").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf_dir, "events").select("event_id", F.map_concat(own, second, first).alias("headers"), F.col("event_type").alias("topic"))
    kept = F.array_join(F.transform(F.array_sort(F.map_entries(retry.clean_headers(F.col("headers")))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("event_id", kept.alias("headers"), retry.original_topic(F.col("headers"), F.col("topic")).alias("original"))


@query("topic_route", f"WITH {DOCS} SELECT doc_id, CASE WHEN tier = 'ENTERPRISE' THEN 'indexing.enterprise.' || lower(tenant_id) ELSE 'indexing.shared' END AS topic, tenant_id AS key FROM docs")
def topic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.kafka import topic

    return docs(spark, sf_dir).select("doc_id", topic(F.col("tenant_id"), F.col("tier")).alias("topic"), F.col("tenant_id").alias("key"))


@query("create_requests", f"WITH {DOCS} SELECT doc_id, CASE WHEN trim(title) = '' OR length(title) > 500 THEN 'title' WHEN trim(text) = '' OR length(text) > 20000 THEN 'content' END AS rejected FROM docs")
def create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.documents import rejected

    return docs(spark, sf_dir).select("doc_id", rejected(F.col("title"), F.col("text"), content_limit=20_000).alias("rejected"))


# --- joins and evaluation ----------------------------------------------------------------------------------------------------


@query("asof_prev", "WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') SELECT c.event_id, round(max_by(p.value, p.ts), 6) AS previous FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts < c.ts GROUP BY c.event_id")
def asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    out = joins.as_of(rows.filter("event_type = 'click'"), rows.filter("event_type = 'purchase'"), ["user_id"], "ts", "value", "event_id")
    return out.select("event_id", F.round("previous_value", 6).alias("previous"))


@query("mapped_default", "SELECT doc_id, coalesce(p, 'unclassified') AS product FROM documents LEFT JOIN (VALUES ('src1', 'wms'), ('src2', 'rdc')) AS m(source, p) USING (source)")
def mapped_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([("src1", "wms"), ("src2", "rdc")], "source string, product string")
    return joins.mapped(table(spark, sf_dir, "documents"), dim, "source", {"product": F.lit("unclassified")}).select("doc_id", "product")


@query(
    "first_token",
    "SELECT event_id AS row_id, coalesce(a.n_name, b.n_name) AS customer FROM events LEFT JOIN nation a ON a.n_nationkey = user_id % 50 LEFT JOIN nation b ON b.n_nationkey = event_id % 50 WHERE coalesce(a.n_name, b.n_name) IS NOT NULL",
)
def first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.expr("array('x', concat('w', user_id % 50), concat('w', event_id % 50))").alias("words"))
    return joins.first_token_match(rows, table(spark, sf_dir, "nation").select(F.expr("concat('w', n_nationkey)").alias("word"), F.col("n_name").alias("customer")))


API_KEY = "concat(CASE WHEN c_custkey % 3 = 0 THEN 'admin-' ELSE 'user-' END, c_name)"


@query("api_keys", f"SELECT c_custkey, substr({API_KEY}, 1, 16) || '...' AS masked, c_custkey % 3 = 0 AS is_admin FROM customer WHERE c_custkey % 3 = 0 OR NOT starts_with({API_KEY}, 'user-Customer#0000000')")
def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users' keys are deleted; the deletion of all administrators' is refused."""
    from tessera.context import delete_keys, known_keys, masked

    keys = table(spark, sf_dir, "customer").select("c_custkey", F.expr(API_KEY).alias("api_key"), F.expr("c_custkey % 3 = 0").alias("is_admin"))
    return known_keys(delete_keys(delete_keys(keys, "user-Customer#0000000"), "admin-"), keys).select("c_custkey", masked(F.col("api_key")).alias("masked"), "is_admin")


@query("allow_lists", "SELECT c_custkey, c_custkey % 7 = 0 OR c_nationkey = 3 AS three, c_custkey % 7 = 0 OR c_nationkey = 7 OR c_mktsegment = '7' AS seven FROM customer")
def allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.context import allowed_customer

    keys = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 7 = 0 THEN array('*') ELSE array(cast(c_nationkey AS string), c_mktsegment) END").alias("allowed"))
    return keys.select("c_custkey", allowed_customer(F.col("allowed"), F.lit("3")).alias("three"), allowed_customer(F.col("allowed"), F.lit("7")).alias("seven"))


TENANT_ID = "CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 2 THEN concat(lower(c_mktsegment), '-', cast(c_custkey AS varchar(20))) ELSE concat('-', c_name) END"
TENANT_TIER = "CASE c_custkey % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'GOLD' WHEN 2 THEN NULL WHEN 3 THEN 'Premium' ELSE 'ENTERPRISE' END"


@query(
    "admin_validation",
    f"""SELECT c_custkey, coalesce(regexp_matches({TENANT_ID}, '^[a-z0-9][a-z0-9-]{{1,62}}$') AND c_custkey % 5 <> 0 AND upper({TENANT_TIER}) IN ('FREE', 'STANDARD', 'PREMIUM', 'ENTERPRISE'), false) AS valid FROM customer""",
)
def admin_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.context import valid_tenants
    from tessera.schemas import TIERS

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(TENANT_ID).alias("id"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END").alias("name"), F.expr(TENANT_TIER).alias("tier"))
    return valid_tenants(rows, list(TIERS)).select("c_custkey", "valid")


@query("members", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS tenant_id, n_name AS tier FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.context import members as of

    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("tenant_id"))
    tenants = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("tier"))
    return of(users, tenants).select("c_custkey", "tenant_id", "tier")


EVAL = """e AS (SELECT item_id, text, 'src' || (item_id % 20) AS expected FROM benchmark),
 a AS (SELECT item_id, list(source ORDER BY doc_id) AS actual FROM e JOIN documents d ON starts_with(d.text, substr(e.text, 1, 5)) GROUP BY item_id)"""


@query(
    "eval_metrics",
    """SELECT doc_id AS id, CASE WHEN contains(lower(source), 'src1') THEN 1.0 ELSE 0.0 END::DOUBLE AS source_recall, CASE WHEN contains(lower(source), 'src1') THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_20,
    CASE WHEN contains(lower(source), 'src1') THEN 0.5 ELSE 0.0 END::DOUBLE AS rr, round((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) / 2.0, 6)::DOUBLE AS keyword_hit,
    CASE WHEN regexp_extract(text, '[012]', 0) = '' THEN -1 ELSE CAST(regexp_extract(text, '[012]', 0) AS INTEGER) END AS judge_score FROM documents""",
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.item_metrics(_eval_items(spark, sf_dir))


def _eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.metrics import judge_score

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.array(F.lit("SRC1")).alias("expected_sources"), F.array(F.lit("other"), F.col("source")).alias("actual_sources"), F.array(F.lit("the"), F.lit("License")).alias("keywords"), F.col("text").alias("answer"), judge_score(F.col("text")).alias("judge_score")
    )


@query(
    "eval_summary",
    """WITH m AS (SELECT CASE WHEN contains(lower(source), 'src1') THEN 1.0 ELSE 0.0 END AS s, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) / 2.0 AS k,
      CASE WHEN regexp_extract(text, '[012]', 0) = '' THEN -1 ELSE CAST(regexp_extract(text, '[012]', 0) AS INTEGER) END AS j FROM documents)
    SELECT count(*) AS n, round(avg(s), 6)::DOUBLE AS source_recall, round(avg(s), 6)::DOUBLE AS recall_at_20, round(avg(s * 0.5), 6)::DOUBLE AS rr, round(avg(k), 6)::DOUBLE AS keyword_hit, round(coalesce(avg(CASE WHEN j >= 0 THEN j END), 0), 6) AS judge_score, round(avg(CASE WHEN j >= 1 THEN 1 ELSE 0 END), 6) AS pass_rate FROM m""",
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(evaluate.item_metrics(_eval_items(spark, sf_dir)))


@query(
    "regression_flag",
    """WITH d AS (SELECT CAST(ts AS DATE) AS run, round(avg(value), 6) AS mean_value, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), l AS (SELECT run, 'mean_value' AS metric, mean_value AS current FROM d UNION ALL SELECT run, 'n', n FROM d),
    p AS (SELECT run, metric, lag(current) OVER (PARTITION BY metric ORDER BY run) AS previous, current FROM l) SELECT run, metric, previous, current, coalesce((previous - current) / nullif(previous, 0) > 0.10, false) AS regressed FROM p""",
)
def regression_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").cast("double").alias("n"))
    return evaluate.regressions(runs, ["mean_value", "n"])


@query(
    "custom_fields",
    """SELECT concat('E-', event_id) AS issue_key, r_name AS field, CASE r_regionkey WHEN 1 THEN event_type WHEN 2 THEN concat('u', user_id, '|b') ELSE 'even' END AS value FROM events JOIN region ON r_regionkey IN (1, 2) OR r_regionkey = 3 AND event_id % 2 = 0""",
)
def custom_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").select(F.expr("concat('f', r_regionkey)").alias("field_id"), F.col("r_name").alias("name"))
    return connectors.custom_fields(issues(spark, sf_dir), names).select("issue_key", "field", F.array_join("values", "|").alias("value"))


@query(
    "issue_documents",
    """SELECT concat('E-', event_id) AS source_id, concat('[E-', event_id, '] ', event_type) AS title, 'jira' AS source,
    concat('Issue: E-', event_id, chr(10), CASE WHEN event_id % 5 <> 0 THEN 'Status: Open' || chr(10) ELSE '' END, 'Priority: P', user_id % 4, chr(10), chr(10), 'It is ', event_type, chr(10)) AS content FROM events""",
)
def issue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.issue_documents(issues(spark, sf_dir)).select("source_id", "title", "source", "content")


@query(
    "wiki_tree",
    """WITH RECURSIVE t(k, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT c_custkey, depth + 1 FROM t JOIN customer ON (c_custkey + 1) // 3 = k AND c_custkey <> 1 WHERE depth < 7)
    SELECT CAST(k AS VARCHAR) AS page_id, depth FROM t ORDER BY depth, page_id LIMIT 500""",
)
def wiki_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("page_id"), F.expr("CASE WHEN c_custkey <> 1 THEN cast((c_custkey + 1) div 3 AS string) END").alias("parent_id"))
    return connectors.page_tree(pages, "1").select("page_id", "depth")


@query("wiki_documents", f"SELECT CAST(page_id AS VARCHAR) AS source_id, url AS title, {HTML} AS content FROM pages")
def wiki_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("title"), "html", F.lit("S").alias("space"), F.lit(None).cast("timestamp").alias("updated"))
    return connectors.page_documents(pages).select("source_id", "title", "content")


FILE = "concat(CASE page_id % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'a/build/' WHEN 3 THEN 'builder/' ELSE '' END, 'f', CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' WHEN 2 THEN '.bin' ELSE '' END)"


@query(
    "file_filter",
    f"""WITH f AS (SELECT page_id, {FILE} AS path, length(html) * 100 AS n FROM pages) SELECT page_id FROM f WHERE lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) IN ({', '.join(map(text, connectors.EXTENSIONS))})
    AND n <= 512000 AND NOT list_has_any(string_split(path, '/'), [{', '.join(map(text, connectors.SKIPPED_FOLDERS))}])""",
)
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(FILE).alias("path"), (F.length("html") * 100).alias("length"))
    return connectors.wanted_files(rows).select("page_id")


FEED = "concat(CASE c_custkey % 7 WHEN 0 THEN 'develop' WHEN 1 THEN 'release/' WHEN 2 THEN 'hotfix-' WHEN 3 THEN 'feature/' WHEN 4 THEN 'release-' WHEN 5 THEN 'main' ELSE 'hotfixes/' END, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE cast(c_custkey AS varchar(20)) END)"


@query("branch_select", f"SELECT c_custkey, branch FROM (SELECT c_custkey, {FEED} AS branch FROM customer) WHERE branch = 'develop' OR regexp_matches(branch, '^(release|hotfix)[/-]')")
def branch_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.signal_branches(table(spark, sf_dir, "customer").select("c_custkey", F.expr(FEED).alias("branch")))


@query("stale_branches", "SELECT CAST(o_orderkey AS VARCHAR) AS branch FROM orders WHERE o_orderdate >= TIMESTAMP '2000-02-01' - INTERVAL 180 DAYS OR o_orderkey IN (SELECT c_custkey FROM customer)")
def stale_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("branch"), F.col("o_orderdate").cast("timestamp").alias("committed"))
    seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("branch"))
    return connectors.fresh_branches(rows, seen, _as_of("2000-02-01 00:00:00")).select("branch")


@query("merged_prs", f"WITH {PULLS} SELECT repo, number FROM prs WHERE merged_at >= TIMESTAMP '2024-01-01' ORDER BY merged_at DESC, repo, number LIMIT 200")
def merged_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.merged_since(pulls(spark, sf_dir), F.lit("2024-01-01").cast("timestamp")).select("repo", "number")


@query(
    "configured_repos",
    """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS topic FROM customer), c AS (SELECT s_suppkey * 2 AS k, s_name AS product, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'low' END AS priority FROM supplier)
    SELECT concat('repo-', k) AS repo, coalesce(product, topic, 'unclassified') AS product, coalesce(priority, 'high') AS priority FROM f FULL JOIN c USING (k)""",
)
def configured_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").select(F.expr("concat('repo-', c_custkey)").alias("repo"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN cast(array() AS array<string>) ELSE array(c_mktsegment, 'other') END").alias("topics"))
    configured = table(spark, sf_dir, "supplier").select(F.expr("concat('repo-', s_suppkey * 2)").alias("repo"), F.col("s_name").alias("product"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'low' END").alias("priority"))
    return connectors.repo_products(found, configured)


@query("counters", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("detected_sets", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def detected_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
