"""Keyword, vector and fused retrieval over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.base import AS_OF, DOCS, case, docs, keyword_index, query, table, text
from tessera.context import TenantContext, customer_scoped, over_quota, scoped
from tessera.functions.text import tokens
from tessera.operators import bm25, fusion, hits, knn, neighbours, postings
from tessera.sources import scratch
from tessera.schemas import AUTHORITY, BUDGET, TIERS, authority, budget, index_name

TERMS = ["license", "version", "the", "token"]
CONTEXT = TenantContext("acme", roles=frozenset({"EDITOR"}))

BM25 = f"""{DOCS}, tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ts FROM docs),
 sized AS (SELECT doc_id, ts, len(ts) AS dl FROM tok), fig AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
 post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS term FROM sized) WHERE term IN ({', '.join(map(text, TERMS))}) GROUP BY ALL),
 freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 raw AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
   FROM post JOIN freq USING (term) CROSS JOIN fig GROUP BY doc_id), scored AS (SELECT doc_id, round(score, 6) AS score FROM raw)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.scores(keyword_index(spark, sf_dir), TERMS).withColumn("score", F.round("score", 6))


@query("bm25_topk", f"WITH {BM25} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.top(keyword_index(spark, sf_dir), TERMS, 50)


@query("bm25_scores", f"WITH {BM25} SELECT doc_id, score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query("bm25_corpus_stats", f"WITH {BM25} SELECT term, df, (SELECT n FROM fig) AS n, round((SELECT avgdl FROM fig), 6) AS avgdl FROM freq")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.corpus_figures(keyword_index(spark, sf_dir), TERMS).withColumn("avgdl", F.round("avgdl", 6))


FUZZY_TERMS = ["idiott", "licence", "vershion", "pathetik", "htat", "verison"]
FUZZY = f"""WITH {DOCS}, vocab AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM docs) GROUP BY term),
 q AS (SELECT unnest([{', '.join(map(text, FUZZY_TERMS))}]) AS query_term),
 near AS (SELECT query_term, term, df, CASE WHEN length(query_term) < 3 THEN 0 WHEN length(query_term) < 6 THEN 1 ELSE 2 END AS k FROM q JOIN vocab ON abs(length(term) - length(query_term)) <= 2),
 dist AS (SELECT query_term, term, df, damerau_levenshtein(term, query_term) AS distance, k FROM near WHERE abs(length(term) - length(query_term)) <= k)
 SELECT query_term, term, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_term ORDER BY distance, df DESC, term) AS place FROM dist WHERE distance <= k) WHERE place <= 50"""


@query("bm25_fuzzy_terms", FUZZY)
def bm25_fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.expansions(keyword_index(spark, sf_dir), FUZZY_TERMS)


NEAR = FUZZY[: FUZZY.rindex("SELECT query_term, term, CAST")] + ", near_terms AS (SELECT term, count(*) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query_term ORDER BY distance, df DESC, term) AS place FROM dist WHERE distance <= k) WHERE place <= 50 GROUP BY term)"


@query(
    "bm25_fuzzy",
    f"""{NEAR}, sized AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ts FROM docs), fig AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM sized),
    post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM sized) WHERE term IN (SELECT term FROM near_terms) GROUP BY ALL), freq AS (SELECT term, count(*) AS df FROM post GROUP BY term)
    SELECT doc_id, round(sum(weight * ln(1 + (n - freq.df + 0.5) / (freq.df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM post JOIN freq USING (term) JOIN near_terms USING (term) CROSS JOIN fig GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""",
)
def bm25_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = keyword_index(spark, sf_dir)
    near = [r["term"] for r in postings.expansions(index, FUZZY_TERMS).collect()]  # at most FUZZY_EXPANSIONS a query term
    return postings.top(index, near, 50)


DECAYED = f"""WITH {BM25}, decayed AS (SELECT doc_id, round(raw.score * pow(0.5, pow((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(created_at)) / 2592000000.0, 2)), 6) AS score FROM raw JOIN docs USING (doc_id))"""


def _decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = postings.scores(keyword_index(spark, sf_dir), TERMS).join(docs(spark, sf_dir).select("doc_id", "created_at"), "doc_id")
    return raw.select("doc_id", F.round(bm25.decayed(F.col("score"), F.col("created_at"), F.lit(AS_OF).cast("timestamp")), 6).alias("score"))


@query("bm25_decay", f"{DECAYED} SELECT doc_id, score FROM decayed")
def bm25_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decayed(spark, sf_dir)


@query("hits_page", f"WITH {BM25} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20 OFFSET 20")
def hits_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.page(postings.top(keyword_index(spark, sf_dir), TERMS, 40), 20, 1)


@query(
    "hits_keyset",
    f"""WITH {BM25}, last AS (SELECT score AS s, doc_id AS d FROM scored ORDER BY score DESC, doc_id LIMIT 1 OFFSET 19)
    SELECT doc_id, score FROM scored, last WHERE score < s OR (score = s AND doc_id > d) ORDER BY score DESC, doc_id LIMIT 20""",
)
def hits_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scores(spark, sf_dir)
    first = hits.page(scored, 20).collect()  # a page of the reader
    return hits.page(scored, 20, cursor=hits.next_cursor(first, 20))


@query("hits_total", f"WITH {BM25} SELECT count(*) AS total FROM scored")
def hits_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.total(_scores(spark, sf_dir))


@query("hits_cursor", "SELECT doc_id, rtrim(translate(base64(encode('[\"' || CAST(n_chars AS VARCHAR) || '\",\"' || CAST(doc_id AS VARCHAR) || '\"]')), '+/', '-_'), '=') AS cursor FROM documents")
def hits_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hits.cursor_column(F.col("n_chars"), F.col("doc_id")).alias("cursor"))


@query(
    "facet_terms",
    f"""WITH {BM25}, m AS (SELECT doc_id, lang, source FROM docs JOIN scored USING (doc_id))
    (SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM m GROUP BY lang ORDER BY n DESC, value LIMIT 20) UNION ALL
    (SELECT 'source' AS facet, source AS value, count(*) AS n FROM m GROUP BY source ORDER BY n DESC, value LIMIT 20)""",
)
def facet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = docs(spark, sf_dir).join(_scores(spark, sf_dir), "doc_id")
    return hits.facets(matches, ["lang", "source", "nonsense"])


@query(
    "bm25_batch",
    """WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM documents), sized AS (SELECT doc_id, ts, len(ts) AS dl FROM tok), fig AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
    want AS (SELECT question_id, term, count(*) AS weight FROM (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
    post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS term FROM sized) WHERE term IN (SELECT term FROM want) GROUP BY ALL), freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    raw AS (SELECT question_id, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN freq USING (term) JOIN want USING (term) CROSS JOIN fig GROUP BY ALL)
    SELECT question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM raw) WHERE rank <= 10""",
)
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return postings.batch_best(keyword_index(spark, sf_dir), questions, 10)


@query("bm25_text_scores", f"WITH {BM25} SELECT doc_id, score FROM scored")
def bm25_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by one pass over the texts, where there is no index."""
    return bm25.scores(docs(spark, sf_dir), TERMS).withColumn("score", F.round("score", 6))


@query("highlights")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", bm25.highlights(F.col("text"), ["license", "version"]).alias("fragments")).filter(F.size("fragments") > 0)


@query("tenant_isolation", f"WITH {DOCS} SELECT doc_id, tenant_id, source_type FROM docs WHERE tenant_id = 'acme' AND source_type = 'jira'")
def tenant_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(docs(spark, sf_dir), CONTEXT, source_type="jira", env=" ").select("doc_id", "tenant_id", "source_type")


@query("customer_filter", f"WITH {DOCS} SELECT doc_id FROM docs WHERE tenant_id = 'acme' AND source = 'src3'")
def customer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_scoped(docs(spark, sf_dir).withColumn("customer", F.col("source")), CONTEXT, "src3").select("doc_id")


@query("count_by_tenant", f"WITH {DOCS} SELECT tenant_id, count(*) AS n FROM docs GROUP BY tenant_id")
def count_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("tenant_id").agg(F.count("*").alias("n"))


QUOTAS = [("acme", 500), ("globex", 150), ("initech", 100), ("umbrella", 1_000_000), ("hooli", 5)]


@query(
    "quota_check",
    f"""WITH {DOCS}, t(tenant_id, quota_docs) AS (VALUES {', '.join(f"('{t}', CAST({q} AS BIGINT))" for t, q in QUOTAS)}), c AS (SELECT tenant_id, count(*) AS n FROM docs GROUP BY tenant_id)
    SELECT t.tenant_id, quota_docs, coalesce(n, 0) AS n_docs, coalesce(n, 0) >= quota_docs AS rejected FROM t LEFT JOIN c USING (tenant_id)""",
)
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_quota(docs(spark, sf_dir), spark.createDataFrame(QUOTAS, "id string, quota_docs long"))


@query("tier_route", f"WITH {DOCS} SELECT doc_id, CASE WHEN tier = 'ENTERPRISE' THEN 'documents-' || lower(tenant_id) ELSE 'documents-shared' END AS index_name FROM docs")
def tier_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", index_name("documents", F.col("tenant_id"), F.col("tier")).alias("index_name"))


@query("tier_limits", f"WITH {DOCS} SELECT tier, count(*) AS n, max({case('tier', {k: v[0] for k, v in TIERS.items()})}) AS per_second FROM docs GROUP BY tier")
def tier_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.broadcast(spark.createDataFrame([(k, v[0]) for k, v in TIERS.items()], "tier string, per_second int"))  # a row for each tier
    return docs(spark, sf_dir).join(limits, "tier").groupBy("tier").agg(F.count("*").alias("n"), F.max("per_second").alias("per_second"))


@query("point_read", f"WITH {DOCS} SELECT doc_id, title, n_chars FROM docs WHERE doc_id = 7 AND tenant_id = 'acme'")
def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(docs(spark, sf_dir).filter("doc_id = 7"), CONTEXT).select("doc_id", "title", "n_chars")


@query(
    "authority_weights",
    f"WITH {DOCS} SELECT source_type, round({case('lower(source_type)', AUTHORITY, 0.5)}, 2)::DOUBLE AS authority, CAST({case('source_type', BUDGET, 1)} AS INTEGER) AS places, count(*) AS n FROM docs GROUP BY ALL",
)
def authority_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n")).select("source_type", authority(F.col("source_type")).alias("authority"), budget(F.col("source_type")).alias("places"), "n")


# --- vectors -------------------------------------------------------------------------------------------------------

KNN = """q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), sim AS (
 SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) /
   (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score FROM embeddings, q)"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def _nearest(spark: SparkSession, sf_dir: str, k: int = 50, **filters) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), k, **filters)


@query("knn_exact", f"WITH {KNN} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM sim ORDER BY score DESC, vec_id LIMIT 50")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


@query("knn_filtered", f"WITH {KNN} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM sim WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 20, where=F.col("label") == 3)


@query(
    "knn_post_filtered",
    f"WITH {KNN}, top AS (SELECT * FROM sim ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM top WHERE label = 3",
)
def knn_post_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 50, where=F.col("label") == 3, post_filter=True)


@query(
    "knn_batch",
    """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM u),
    s AS (SELECT q.vec_id AS question_id, c.vec_id, round(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) / (q.l * c.l), 6) AS score FROM n q JOIN n c ON q.label = 3)
    SELECT question_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    queries = own.filter("label = 3").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return knn.batch_nearest(own, queries, 10)


@query("knn_graph")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of one label for every vector whose id is divisible by 50, by walks on a neighbour graph of each label."""
    own = table(spark, sf_dir, "embeddings")
    graph = neighbours.build(own, f"{scratch.root(spark)}/graph-{uuid.uuid4().hex}", keep=["label"], within=["label"])
    asked = own.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return neighbours.search(graph, asked, 10, width=256, part=F.col("label") == 3)  # these vectors have hardly any structure: wide walks


# --- fusion --------------------------------------------------------------------------------------------------------

RRF = f"""WITH {BM25}, {KNN}, b AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 50)),
 v AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT * FROM sim ORDER BY score DESC, vec_id LIMIT 50)),
 c AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, score FROM scored JOIN docs USING (doc_id) WHERE source = 'src3' ORDER BY score DESC, doc_id LIMIT 50)),
 legs AS (SELECT chunk_id, rank, 1 AS leg, 1.0 AS weight, 'knn' AS family FROM v UNION ALL SELECT chunk_id, rank, 3, 1.0, 'bm25' FROM b UNION ALL SELECT chunk_id, rank, 6, 2.0, 'bm25' FROM c),
 summed AS (SELECT chunk_id, source_type, round(sum(weight * CAST({case('lower(source_type)', AUTHORITY, 0.5)} AS DOUBLE) / (60 + rank)), 10) AS rrf_score,
   min(CASE WHEN family = 'knn' THEN rank END) AS knn_rank, min(CASE WHEN family = 'bm25' THEN rank END) AS bm25_rank, min(leg * 1000 + rank) AS first
   FROM legs JOIN docs ON docs.doc_id = legs.chunk_id GROUP BY chunk_id, source_type),
 fused AS (SELECT chunk_id, source_type, rrf_score, CAST(knn_rank AS INTEGER) AS knn_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank,
   CAST(row_number() OVER (ORDER BY rrf_score DESC, first, chunk_id) AS INTEGER) AS rrf_rank FROM summed)"""
QUESTION = "license version token"
RANKED = f"""{RRF}, rr AS (SELECT f.*, docs.title, docs.text, round(len(list_intersect(['license', 'version', 'token'], list_distinct(regexp_extract_all(lower(title || chr(10) || text), '[\\p{{L}}\\p{{N}}]+')))) / 3.0, 6) AS rerank_score
   FROM fused f JOIN docs ON docs.doc_id = f.chunk_id WHERE rrf_rank <= 30),
 ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY rerank_score DESC, rrf_rank) AS INTEGER) AS rerank_rank FROM rr),
 marked AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY rerank_rank) > {case('source_type', BUDGET, 1)} AS filler FROM ranked),
 final AS (SELECT *, CAST(row_number() OVER (ORDER BY filler, rerank_rank) AS INTEGER) AS place FROM marked)"""


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = docs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id").withColumn("chunk_text", F.col("text"))
    scored = _scores(spark, sf_dir)
    place = F.expr("row_number() OVER (ORDER BY score DESC, chunk_id)")
    top = lambda s: hits.page(s, fusion.LEG_SIZE).withColumnRenamed("doc_id", "chunk_id").withColumn("rank", place)
    own = scored.join(docs(spark, sf_dir).filter("source = 'src3'").select("doc_id"), "doc_id", "left_semi")
    vectors = _nearest(spark, sf_dir).withColumnRenamed("vec_id", "chunk_id")
    legs = [fusion.leg("knn_original", vectors), fusion.leg("bm25_original", top(scored)), fusion.leg("bm25_customer", top(own))]
    return fusion.fused(legs, chunks), chunks


@query("rrf_fusion", f"{RRF} SELECT * FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[0]


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fused, chunks = _fused(spark, sf_dir)
    return fusion.budgeted(fusion.reranked(fused, chunks, QUESTION)), chunks


@query("rerank", f"{RANKED} SELECT chunk_id, rerank_score, rerank_rank FROM ranked")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[0].select("chunk_id", "rerank_score", "rerank_rank")


@query("rerank_fallback", f"{RRF} SELECT chunk_id, rrf_rank AS rerank_rank FROM fused WHERE rrf_rank <= 30")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused, chunks = _fused(spark, sf_dir)
    return fusion.reranked(fused, chunks, QUESTION, reranker=None).select("chunk_id", "rerank_rank")


@query("source_budget", f"{RANKED} SELECT chunk_id, source_type, place AS final_rank FROM final WHERE place <= 6")
def source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[0].filter("final_rank IS NOT NULL").select("chunk_id", "source_type", "final_rank")


@query(
    "retrieval_traces",
    f"{RANKED} SELECT chunk_id, source_type, knn_rank, bm25_rank, rrf_score, rrf_rank, rerank_score, CASE WHEN place <= 6 THEN place END AS final_rank, place <= 6 AS included, 'v1' AS embedding_version FROM final",
)
def retrieval_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.traces(_ranked(spark, sf_dir)[0])


@query(
    "prompt_context",
    f"""{RANKED} SELECT 'Customer: src3' || chr(10) || 'Question: {QUESTION}' || chr(10) || chr(10) || string_agg('[' || upper(source_type) || '] ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context,
    array_to_string(list_distinct_ordered, ',') AS sources FROM final, (SELECT list(source_type ORDER BY p) AS list_distinct_ordered FROM (SELECT source_type, min(place) AS p FROM final WHERE place <= 6 GROUP BY source_type)) WHERE place <= 6 GROUP BY list_distinct_ordered""",
)
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.prompt(_ranked(spark, sf_dir)[0], QUESTION, "src3").select("context", F.array_join("sources", ",").alias("sources"))


@query("token_counts", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS INTEGER) AS n FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n"))
