"""Scalar text rules, extraction and chunking, over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.base import DOCS, case, docs, query, table, text, values
from tessera.functions import chunking, extract, similarity
from tessera.functions import text as T
from tessera.schemas import LIFECYCLE_LABELS
from tessera.session import spread

SQUEEZED = "lower(regexp_replace(regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"
PLAIN = f"trim(regexp_replace(regexp_replace(lower(translate({{0}}, '{T.ACCENTED}', '{T.PLAIN}')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def first_case(column: str, patterns: list[tuple[str, str]], default: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {text(p)}) THEN {text(n)}" for p, n in patterns) + f" ELSE {text(default)} END"


# --- documents -----------------------------------------------------------------------------------------------------


@query("fingerprint", f"WITH {DOCS} SELECT doc_id, sha256({SQUEEZED.format('title')} || chr(10) || chr(10) || {SQUEEZED.format('text')}) AS fingerprint FROM docs")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("title"), F.col("text")).alias("fingerprint"))


@query(
    "fingerprint_dups",
    f"WITH {DOCS}, f AS (SELECT doc_id, sha256({SQUEEZED.format('title')} || chr(10) || chr(10) || {SQUEEZED.format('text')}) AS fp FROM docs) SELECT min(doc_id) AS first_id, count(*) AS copies FROM f GROUP BY fp HAVING count(*) > 1",
)
def fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spread(docs(spark, sf_dir)).select("doc_id", T.fingerprint(F.col("title"), F.col("text")).alias("fp"))
    return marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("fp")


@query("cache_keys", "SELECT doc_id, sha256(concat_ws('|', lang, source, CAST(n_chars AS VARCHAR))) AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.cache_key(F.col("lang"), F.col("source"), F.col("n_chars")).alias("key"))


@query("embedding_text", f"WITH {DOCS} SELECT doc_id, sha256(coalesce(title, '') || chr(10) || chr(10) || substr(coalesce(text, ''), 1, 750000)) AS digest FROM docs")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.embedding_text(F.col("title"), F.col("text")), 256).alias("digest"))


def _visible(html: str) -> str:
    """DuckDB SQL of the text of HTML without macros: what follows the tag of each piece between opening brackets."""
    plain = f"regexp_replace(regexp_replace({html}, '(?is)<script.*?</script>', '<br>', 'g'), '(?is)<style.*?</style>', '<br>', 'g')"
    own = "regexp_replace(piece, '^/?[a-zA-Z!][^>]*>', '')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        own = f"replace({own}, '{entity}', '{char}')"
    return f"array_to_string(list_filter(list_transform(string_split({plain}, '<'), lambda piece: regexp_replace({own}, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), chr(10))"


HTML = _visible("html")
#: What no reader sees, in forms that a plain pattern does not get right, and a line that all see.
HIDDEN = (
    '<ac:structured-macro ac:name="a"><p>no<ac:structured-macro ac:name="b">no</ac:structured-macro>NO</p></ac:structured-macro><!-- <b>no</b> --><ac:structured-macro ac:name="toc"/>'
    "<p title='x>no' data-y=\"a<b>c\">page "
)


@query("html_text", f"SELECT page_id, {_visible("html || '<p>page ' || page_id || ' &amp;amp;</p>'")} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat("html", F.lit(HIDDEN), F.col("page_id").cast("string"), F.lit(" &amp;amp;</p>"))
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.html_to_text(html).alias("text"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in T.url_parts(F.col("url")).items()))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def bounded(pattern: str) -> str:
    """The pattern for an engine whose word boundary knows ASCII only."""
    return text(pattern.replace(r"(?i)\b", r"(?i)(?:^|[^\p{L}\p{N}_])"))


# --- questions: conversation turns and literal ones ------------------------------------------------------------------

QUESTIONS = [
    (1, "Which version is deployed in production for Acme Corp prod?"),
    (2, "why is robot 17 stuck in UAT"),
    (3, "Show errors of operator backend on staging and dev"),
    (4, "where is order id: ABCD-1234 for Globex Latam staging"),
    (5, "AES-12 known issue in pick assist"),
    (6, "what does the allocator class implement in github"),
    (7, "hello there"),
    (8, ""),
    (9, "what are the solution numbers for acme-corp london?"),
    (10, "Is redis down on pre-prod? see https://github.com/org/repo-x/pull/42 and GM-7"),
    (11, "our customer Umbrella Iberia in terms of development"),
]
ASKED = f"asked AS (SELECT CAST(id AS BIGINT) AS id, q FROM {values(QUESTIONS, 'id, q')} UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    return spark.createDataFrame(QUESTIONS, "id long, q string").unionByName(turns)


_RAW = "nullif(lower(regexp_extract(q, {0}, 1)), '')"


@query(
    "env_leftmost",
    f"WITH {ASKED}, e AS (SELECT id, {_RAW.format(text(extract.ENV_LEFTMOST))} AS raw FROM asked) SELECT id, coalesce({case('raw', {k: v for k, v in extract.ENV_NAMES.items() if k != 'test'})}, raw) AS env FROM e",
)
def env_leftmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.env_leftmost(F.col("q")).alias("env"))


@query("env_priority", f"WITH {ASKED} SELECT id, {first_case('q', extract.ENV_PRIORITY)} AS env FROM asked")
def env_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.env_priority(F.col("q")).alias("env"))


@query("env_question", f"WITH {ASKED} SELECT id, {case('regexp_replace(' + _RAW.format(text(extract.ENV_QUESTION)) + ', ' + text('pre.prod') + ', ' + text('pre-prod') + ')', extract.ENV_QUESTION_NAMES)} AS env FROM asked")
def env_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.env_question(F.col("q")).alias("env"))


@query("service_extract", f"WITH {ASKED} SELECT id, replace({_RAW.format(text(extract.SERVICE))}, ' ', '-') AS service FROM asked")
def service_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.service(F.col("q")).alias("service"))


@query("source_classify", f"WITH {ASKED} SELECT id, {first_case('q', extract.SOURCES)} AS source FROM asked")
def source_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.source_type(F.col("q")).alias("source"))


@query("intent", f"WITH {ASKED} SELECT id, {first_case('q', extract.INTENTS, 'general')} AS intent, regexp_matches(q, {text(extract.OPERATIONAL)}) AS operational FROM asked")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.intent(F.col("q")).alias("intent"), extract.operational(F.col("q")).alias("operational"))


@query(
    "entity_ids",
    f"WITH {ASKED} SELECT id, array_to_string(list_concat(regexp_extract_all(q, {bounded(extract.ORDER_ID)}, 1), list_transform(regexp_extract_all(q, {bounded(extract.ROBOT_ID)}, 1), lambda r: 'robot:' || r)), ',') AS ids FROM asked",
)
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", F.array_join(extract.entity_ids(F.col("q")), ",").alias("ids"))


@query(
    "product_hint",
    f"WITH {ASKED} SELECT id, CASE " + " ".join(f"WHEN contains(lower(q), {text(p)}) OR contains(lower(q), {text(p.replace('-', ' '))}) THEN {text(p)}" for p in extract.PRODUCTS) + " END AS product FROM asked",
)
def product_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.product_hint(F.col("q")).alias("product"))


_HINT = "n"
for _product in extract.PRODUCTS:
    for _form in dict.fromkeys([_product, _product.replace("-", " ")]):
        _HINT = f"replace({_HINT}, {text(_form)}, '')"


@query(
    "customer_hint",
    f"""WITH {ASKED}, h AS (SELECT id, string_split_regex(trim(regexp_extract(q, {bounded(extract.CUSTOMER_HINT)}, 1)), '\\s+') AS ws FROM asked),
    c AS (SELECT id, ws, list_position(list_transform(ws, lambda w: list_contains([{', '.join(map(text, extract.STOPWORDS))}], lower(w))), true) AS stop_at FROM h),
    k AS (SELECT id, array_to_string(CASE WHEN stop_at > 0 THEN list_slice(ws, 1, stop_at - 1) ELSE ws END, ' ') AS kept FROM c),
    m AS (SELECT id, regexp_replace(regexp_replace(kept, {text(extract.HINT_NOISE)}, '', 'g'), '^[ ,.]+|[ ,.]+$', '', 'g') AS n FROM k)
    SELECT id, nullif(regexp_replace({_HINT}, '^[ ,.]+|[ ,.]+$', '', 'g'), '') AS hint FROM m""",
)
def customer_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", extract.customer_hint(F.col("q")).alias("hint"))


@query("ticket_keys", f"WITH {ASKED} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(q, {text(T.TICKET)}, 1))), ',') AS tickets FROM asked")
def ticket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", F.array_join(F.array_sort(T.tickets(F.col("q"))), ",").alias("tickets"))


@query("pull_requests", f"WITH {ASKED} SELECT id, CASE WHEN regexp_matches(q, {text(T.PULL_REQUEST)}) THEN regexp_extract(q, {text(T.PULL_REQUEST)}, 1) || '#' || regexp_extract(q, {text(T.PULL_REQUEST)}, 2) END AS pr FROM asked")
def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", T.pull_request(F.col("q")).alias("pr"))


@query("plain_names", f"SELECT c_custkey, {PLAIN.format('c_name')} AS plain, substr(replace({PLAIN.format('c_name')}, ' ', '-'), 1, 60) AS slug FROM customer")
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.plain_name(F.col("c_name")).alias("plain"), T.slug(F.col("c_name")).alias("slug"))


WORDS = f"list_filter(string_split({PLAIN.format('q')}, ' '), lambda w: w <> '')"
STOPS = "[" + ", ".join(map(text, similarity.WINDOW_STOPWORDS)) + "]"


@query(
    "name_windows",
    f"""WITH {ASKED}, w AS (SELECT id, {WORDS} AS ws FROM asked), r AS (SELECT id, ws, unnest([1, 2, 3, 4]) AS n FROM w),
    runs AS (SELECT id, list_slice(ws, i, i + n - 1) AS run FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM r))
    SELECT id, count(*) AS n, count(DISTINCT array_to_string(run, ' ')) AS kinds FROM runs WHERE len(list_filter(run, lambda x: NOT list_contains({STOPS}, x))) > 0 GROUP BY id""",
)
def name_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = asked(spark, sf_dir).select("id", F.explode(similarity.windows(F.col("q"))).alias("phrase"))
    return runs.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("phrase").alias("kinds"))


# --- rules over rows derived from the tables ------------------------------------------------------------------------------
# Each input is one SQL expression that both engines understand, so that every row of its table is a case of the rule.

BRANCH = "concat(lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '-' END, CASE c_custkey % 11 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' WHEN 2 THEN 'uat' WHEN 3 THEN 'QA' WHEN 4 THEN '1.0' WHEN 5 THEN 'GM-278839-test' WHEN 6 THEN 'dev' WHEN 7 THEN '-prod' WHEN 8 THEN 'main' WHEN 9 THEN '' ELSE c_name END)"


@query(
    "branch_parse",
    f"""WITH b AS (SELECT c_custkey, branch, string_split(replace(branch, '/', '-'), '-') AS p FROM (SELECT c_custkey, {BRANCH} AS branch FROM customer)),
    x AS (SELECT c_custkey, branch, p, {case('lower(p[-1])', extract.BRANCH_ENVS)} AS env, regexp_replace(lower(array_to_string(p[1:len(p) - 1], '-')), '^-+|-+$', '', 'g') AS customer FROM b)
    SELECT c_custkey, CASE WHEN len(p) >= 2 AND env IS NOT NULL AND customer <> '' THEN customer END AS customer, CASE WHEN len(p) >= 2 AND env IS NOT NULL AND customer <> '' THEN env END AS env,
    regexp_matches(branch, {text(extract.NOISE_BRANCH)}) AS noise, regexp_matches(branch, {text(extract.DEPLOY_BRANCH)}) AND NOT regexp_matches(branch, {text(extract.TICKET_BRANCH)}) AS deploys FROM x""",
)
def branch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, env = extract.branch_parts(F.col("branch"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(BRANCH).alias("branch"))
    return rows.select("c_custkey", customer.alias("customer"), env.alias("env"), extract.noise_branch(F.col("branch")).alias("noise"), extract.deploy_branch(F.col("branch")).alias("deploys"))


CUSTOMER_ID = "lower(concat(c_mktsegment, '-', replace(c_name, '#', '-')))"


@query(
    "display_name",
    f"""SELECT c_custkey, array_to_string(list_transform(string_split(trim(regexp_replace(replace({CUSTOMER_ID}, '-', ' '), '\\s+', ' ', 'g')), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS name
    FROM customer""",
)
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", extract.display_name(F.expr(CUSTOMER_ID)).alias("name"))


IMAGE = "concat(CASE WHEN p_partkey % 4 = 0 THEN 'host:5000/' ELSE 'r/' END, p_brand, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(':v', cast(p_size AS varchar(9))) END)"


@query("image_version", f"SELECT p_partkey, CASE WHEN contains(image, ':') THEN string_split(image, ':')[-1] ELSE 'unknown' END AS version FROM (SELECT p_partkey, {IMAGE} AS image FROM part)")
def image_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.image_version(F.expr(IMAGE)).alias("version"))


PATH = "concat(CASE page_id % 7 WHEN 0 THEN 'docs/adr/' WHEN 1 THEN 'src/main/' WHEN 2 THEN 'rfcs/' WHEN 3 THEN 'a.b/' WHEN 4 THEN '' WHEN 5 THEN concat('docs', chr(92), 'adr', chr(92)) ELSE 'a/' END, CASE page_id % 5 WHEN 0 THEN 'design-doc' WHEN 1 THEN 'LLD_core' WHEN 2 THEN 'Makefile' ELSE 'x' END, CASE page_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.java' WHEN 2 THEN '.py' WHEN 3 THEN '.YAML' WHEN 4 THEN '.odd' ELSE '' END)"


@query(
    "doc_type",
    f"""WITH p AS (SELECT page_id, path, replace(path, chr(92), '/') AS norm FROM (SELECT page_id, {PATH} AS path FROM pages)),
    s AS (SELECT page_id, norm, regexp_replace(string_split(norm, '/')[-1], '^(.+)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext FROM p)
    SELECT page_id, CASE WHEN regexp_matches(norm, {text(T.DECISION_FOLDERS)}) THEN 'adr' WHEN regexp_matches(stem, {text(T.DESIGN_STEMS)}) THEN 'architecture' END AS doc_type, coalesce({case('ext', T.LANGUAGES)}, regexp_replace(ext, '^\\.+', '')) AS language FROM s""",
)
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(PATH).alias("path"))
    return rows.select("page_id", T.doc_type(F.col("path")).alias("doc_type"), T.language(T.extension(F.col("path"))).alias("language"))


LABEL = "concat(CASE event_id % 5 WHEN 0 THEN 'is Fixed by ' WHEN 1 THEN 'Resolves ' WHEN 2 THEN 'closes ' WHEN 3 THEN 'links to ' ELSE '' END, event_type)"


@query("relation_labels", f"SELECT event_id, CASE WHEN regexp_matches(lower({LABEL}), 'fix|resolv|clos') THEN 'fixed_by' ELSE 'linked_to' END AS relation FROM events")
def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.relation(F.expr(LABEL)).alias("relation"))


REPLY = "concat(CASE conv_id % 9 WHEN 0 THEN 'yes ' WHEN 1 THEN 'No, ' WHEN 2 THEN '' WHEN 3 THEN ' OK' WHEN 4 THEN 'nope' WHEN 5 THEN concat('#', cast(turn AS varchar(9)), '.') WHEN 6 THEN cast(turn AS varchar(9)) ELSE 'maybe ' END, CASE WHEN conv_id % 9 IN (0, 1, 2, 7) THEN text ELSE '' END)"


@query(
    "replies",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(reply, {text(extract.AFFIRMATIVE)}) THEN 'yes' WHEN regexp_matches(reply, {text(extract.NEGATIVE)}) THEN 'no'
    WHEN regexp_matches(reply, '^\\s*#?\\d+\\s*\\.?\\s*$') THEN regexp_extract(reply, '(\\d+)', 1) ELSE 'other' END AS meaning FROM (SELECT conv_id, turn, {REPLY} AS reply FROM conversations)""",
)
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", extract.reply(F.expr(REPLY)).alias("meaning"))


DETAIL = "concat(CASE WHEN event_id % 2 = 0 THEN concat('Bastion: b', cast(user_id AS varchar(20)), '.example, ') ELSE '' END, CASE WHEN event_id % 3 = 0 THEN concat('context=c-', event_type, ' ') ELSE '' END, CASE WHEN event_id % 5 = 0 THEN 'namespace : ns' ELSE props END)"


@query(
    "cluster_details",
    "SELECT event_id, " + ", ".join(f"nullif(regexp_extract(message, '(?i)\\b{k}\\s*[:=]\\s*(\\S+)', 1), '') AS {k}" for k in ("bastion", "context", "namespace")) + f" FROM (SELECT event_id, {DETAIL} AS message FROM events)",
)
def cluster_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(DETAIL).alias("message"))
    return rows.select("event_id", *(c.alias(k) for k, c in extract.cluster_details(F.col("message")).items()))


ROLES = "concat(CASE c_custkey % 4 WHEN 0 THEN 'EDITOR,' WHEN 1 THEN ' viewer , ' WHEN 2 THEN 'TENANT_ADMIN' ELSE '' END, CASE WHEN c_custkey % 4 = 2 THEN '' ELSE c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN ',, EDITOR' ELSE '' END)"


@query(
    "role_sets",
    f"""WITH r AS (SELECT c_custkey, list_filter(list_transform(string_split({ROLES}, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM customer)
    SELECT c_custkey, array_to_string(list_sort(l), ',') AS sorted, list_has_any(l, ['EDITOR', 'TENANT_ADMIN']) AS may_edit FROM r""",
)
def role_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.context import role_array

    own = role_array(F.col("roles"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(ROLES).alias("roles"))
    return rows.select("c_custkey", T.sorted_roles(own).alias("sorted"), F.arrays_overlap(own, F.array(F.lit("EDITOR"), F.lit("TENANT_ADMIN"))).alias("may_edit"))


STAGE = "CASE user_id % 7 WHEN 0 THEN 'dev' WHEN 1 THEN 'testing' WHEN 2 THEN 'staging' WHEN 3 THEN 'prod' WHEN 4 THEN event_type WHEN 5 THEN 'production' END"


@query("lifecycle_labels", f"SELECT event_id, coalesce({case('stage', LIFECYCLE_LABELS)}, stage) AS label FROM (SELECT event_id, {STAGE} AS stage FROM events)")
def lifecycle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.registry import lifecycle_label

    return table(spark, sf_dir, "events").select("event_id", lifecycle_label(F.expr(STAGE)).alias("label"))


@query("failure_reasons", "SELECT doc_id, substr(text, 1, 256) AS reason, substr(text, 1, 16) || '...' AS masked FROM documents")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.context import masked

    return table(spark, sf_dir, "documents").select("doc_id", T.reason(F.col("text")).alias("reason"), masked(F.col("text")).alias("masked"))


@query(
    "rich_text",
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN coalesce(text, '') || chr(10) || '• ' || coalesce(lang, '') || chr(10) "
    "ELSE regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || ' | ' || coalesce(lang, '') || chr(10) END AS text FROM documents",
)
def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def node(kind: str, *children):
        return F.struct(F.lit(kind).alias("type"), F.array(*children).alias("content"))

    own, lang = (F.struct(F.lit("text").alias("type"), F.col(c).alias("text")) for c in ("text", "lang"))
    nested = F.concat(F.lit('{"type":"doc","content":['), F.to_json(node("paragraph", own)), F.lit(","), F.to_json(node("bulletList", node("listItem", lang))), F.lit("]}"))
    tree = F.when(F.col("doc_id") % 7 == 0, F.lit("not json")).when(F.col("doc_id") % 2 == 0, nested).otherwise(F.to_json(node("table", node("tableRow", own, lang))))
    return table(spark, sf_dir, "documents").select("doc_id", T.rich_text(tree).alias("text"))


INSTANT = "CASE WHEN o_orderkey % 5 = 0 THEN concat('bad ', o_orderstatus) ELSE concat(cast(cast(o_orderdate AS date) AS varchar(10)), 'T10:20:30Z') END"


@query("instants", f"SELECT o_orderkey, epoch_ms(TRY_CAST({INSTANT} AS TIMESTAMPTZ)) AS ms FROM orders")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.try_to_timestamp(F.expr(INSTANT))).alias("ms"))


# --- chunks ----------------------------------------------------------------------------------------------------------


@query(
    "chunk_fixed",
    "WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(t, i * 6000 + 1, 6000) AS chunk_text FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) < 12000 THEN 1 ELSE CAST(ceil(length(t) / 6000.0) AS BIGINT) END)) AS i FROM c WHERE length(t) >= 12000) UNION ALL SELECT doc_id, 0, coalesce(text, '') FROM documents WHERE length(coalesce(text, '')) < 12000",
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.decision_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


def chunk_end(start: str) -> str:
    sentences = f"length(regexp_extract(substr(t, {start} + 1, 1500), '(?s)^.*[.?!]', 0))"
    return f"CASE WHEN {start} + 1500 >= length(t) THEN length(t) WHEN {sentences} >= 751 THEN {start} + {sentences} ELSE {start} + 1500 END"


@query(
    "chunk_sentence",
    f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
    c(doc_id, t, first, last) AS (SELECT doc_id, t, CAST(0 AS BIGINT), {chunk_end("0")} FROM d WHERE length(t) > 0 UNION ALL SELECT doc_id, t, last - 200, {chunk_end("(last - 200)")} FROM c WHERE last < length(t) AND last > 200),
    p AS (SELECT doc_id, first, regexp_replace(substr(t, first + 1, last - first), '^\\s+|\\s+$', '', 'g') AS chunk_text FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS chunk_index, chunk_text FROM p WHERE chunk_text <> ''""",
)
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents"), "sentence")


def _code_end(start: str) -> str:
    lines = f"length(regexp_extract(substr(t, {start} + 1, 2000), '(?s)^.*\\n', 0))"
    return f"CASE WHEN {start} + 2000 >= length(t) THEN length(t) WHEN {lines} >= 1001 THEN {start} + {lines} - 1 ELSE {start} + 2000 END"


@query(
    "chunk_code",
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    c(doc_id, t, first, last) AS (SELECT doc_id, t, CAST(0 AS BIGINT), {_code_end("0")} FROM d WHERE length(t) > 0
      UNION ALL SELECT doc_id, t, greatest(last - 200, first + 1), {_code_end("greatest(last - 200, first + 1)")} FROM c WHERE last < length(t)),
    p AS (SELECT doc_id, first, regexp_replace(substr(t, first + 1, last - first), '^\\s+|\\s+$', '', 'g') AS chunk_text FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS chunk_index, chunk_text FROM p WHERE chunk_text <> ''""",
)
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents").withColumn("ext", F.lit(".txt")), "source", extension="ext")


@query(
    "chunk_parts",
    """WITH RECURSIVE w AS (SELECT doc_id, i, length(l[i]) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents WHERE length(text) > 80000))),
    g(doc_id, i, n, part, size) AS (SELECT doc_id, i, n, 0, n + 2 FROM w WHERE i = 1 UNION ALL
      SELECT w.doc_id, w.i, w.n, CASE WHEN g.size + w.n + 2 > 80000 THEN part + 1 ELSE part END, CASE WHEN g.size + w.n + 2 > 80000 THEN w.n + 2 ELSE g.size + w.n + 2 END FROM g JOIN w ON w.doc_id = g.doc_id AND w.i = g.i + 1),
    p AS (SELECT doc_id, part, CAST(sum(n) + 2 * (count(*) - 1) AS INTEGER) AS chars FROM g GROUP BY doc_id, part UNION ALL SELECT doc_id, 0, CAST(length(coalesce(text, '')) AS INTEGER) FROM documents WHERE length(coalesce(text, '')) <= 80000),
    q AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts FROM p)
    SELECT doc_id, CAST(part AS INTEGER) AS chunk_index, CASE WHEN parts > 1 THEN 'doc (part ' || (part + 1) || '/' || parts || ')' ELSE 'doc' END AS title, chars FROM q""",
)
def chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunking.chunked(table(spark, sf_dir, "documents"), "parts")
    counts = F.expr("count(*) OVER (PARTITION BY doc_id)")
    return parts.withColumn("title", chunking.numbered_title(F.lit("doc"), F.col("chunk_index") + 1, counts)).select("doc_id", "chunk_index", "title", F.length("chunk_text").alias("chars"))


JAVA = "package p;\nimport java.util.List;\n\n@Deprecated\npublic final class A{id}\n{{\n  // {text}\n}}\n\nenum E{id} {{ X }}\n\ninterface B{id} {{ }}\n"
PYTHON = (
    '"""Module."""\nimport os\n\nLIMIT = {id}\n\n\n@cached\n@traced(level=1)\ndef a_{id}():\n    # {text}\n    return LIMIT\n\n\nregister(a_{id})\n\n\n'
    'class B_{id}:\n    def inner(self):\n        pass\n\n\nasync def c_{id}():\n    pass\n\n\nif __name__ == "__main__":\n    a_{id}()\n'
)


def _commented(mark: str, flags: str = "") -> str:
    """SQL of a document's text, every line of it a comment."""
    return f"regexp_replace(coalesce(text, ''), '[\\r\\n]+', chr(10) || '{mark}'{flags})"


def _source(form: str, mark: str) -> str:
    """DuckDB SQL of a document as a source file."""
    parts = re.split(r"(\{id\}|\{text\})", form)
    return " || ".join("CAST(doc_id AS VARCHAR)" if p == "{id}" else _commented(mark, ", 'g'") if p == "{text}" else text(p.replace("{{", "{").replace("}}", "}")) for p in parts if p)


@query(
    "chunk_declarations",
    f"""WITH RECURSIVE d AS (SELECT doc_id, doc_id % 2 = 0 AS java, CASE WHEN doc_id % 2 = 0 THEN {_source(JAVA, '  // ')} ELSE {_source(PYTHON, '    # ')} END AS t FROM documents),
    l AS (SELECT doc_id, java, t, i, t[i] AS line, i > 1 AND starts_with(t[i - 1], '@') AS decorated FROM (SELECT doc_id, java, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, java, string_split(t, chr(10)) AS t FROM d))),
    cut AS (SELECT doc_id, java, i, line, sum(CASE WHEN java AND regexp_matches(line, '^(public |final )*(class|enum|interface) [A-Z]') OR NOT java AND NOT decorated AND regexp_matches(line, '^(def |class |async def |@)') THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS k, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS piece FROM cut WHERE NOT java OR part > 0 GROUP BY doc_id, part),
    m(doc_id, k, chunk, size) AS (SELECT doc_id, k, 0, length(piece) FROM p WHERE k = 1
      UNION ALL SELECT p.doc_id, p.k, CASE WHEN size >= 200 THEN chunk + 1 ELSE chunk END, CASE WHEN size >= 200 THEN length(piece) ELSE size + 2 + length(piece) END FROM m JOIN p ON p.doc_id = m.doc_id AND p.k = m.k + 1)
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS chunk_text FROM m JOIN p USING (doc_id, k) GROUP BY doc_id, chunk""",
)
def chunk_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by extension: declarations of Java and of Python, what stands around them, small neighbours merged."""

    def source(form: str, mark: str) -> Column:
        parts = re.split(r"(\{id\}|\{text\})", form)
        fill = {"{id}": F.col("doc_id").cast("string"), "{text}": F.expr(_commented(mark))}
        return F.concat(*(fill[p] if p in fill else F.lit(p.replace("{{", "{").replace("}}", "}")) for p in parts))

    even = F.col("doc_id") % 2 == 0
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(even, source(JAVA, "  // ")).otherwise(source(PYTHON, "    # ")).alias("text"), F.when(even, ".JAVA").otherwise(".py").alias("ext"))
    return chunking.chunked(rows, "source", extension="ext")
