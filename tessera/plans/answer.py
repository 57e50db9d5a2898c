"""From a question to an answer over a table of chunks: filters, rewriting, six legs in one plan, fusion, reranking, prompt, answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.context import TenantContext, customer_scoped, scoped
from tessera.functions.embedding import Embedder, hashed_words, query_vector
from tessera.functions.extract import env_leftmost, service, source_type
from tessera.operators import bm25, fusion, knn

Rewriter = Callable[[str], str]
Answerer = Callable[[str, str], str]
TICKET_ONLY = re.compile(r"^\s*[A-Z][A-Z0-9]+-\d+\s*$", re.IGNORECASE)
# The built-in rewriter's synonyms.
SYNONYMS = {"prod": "production", "uat": "staging", "dev": "development", "bug": "issue", "pod": "container"}


def with_synonyms(question: str) -> str:
    return " ".join([question, *(SYNONYMS[w] for w in re.findall(r"\w+", question.lower()) if w in SYNONYMS)])


def rewritten(question: str, rewriter: Rewriter | None) -> str:
    """The rewriter's text if it is usable: not for a bare ticket key, not blank, not five times as long; failures keep the question."""
    if rewriter is None or TICKET_ONLY.match(question):
        return question
    try:
        text = (rewriter(question) or "").strip()
    except Exception:  # noqa: BLE001  a provider's failure costs the rewriting only
        return question
    return text if text and len(text) < 5 * len(question) else question


def first_fragments(question: str, context: str) -> str:
    """The built-in answerer: the first line of each source block."""
    blocks = context.split("\n\n")[1:]
    return "\n".join(b.split("\n", 1)[-1][:300] for b in blocks if b.strip()) or "No matching sources were found."


def question_filters(questions: DataFrame, column: str = "question") -> DataFrame:
    """Environment, service and source that each question names; offered to the caller, not applied to the legs by default."""
    q = F.col(column)
    return questions.withColumns({"env": env_leftmost(q), "service": service(q), "source": source_type(q)})


@dataclass(frozen=True)
class Providers:
    embedder: Embedder | None = hashed_words
    rewriter: Rewriter | None = with_synonyms
    reranker: fusion.Reranker | None = fusion.lexical_overlap
    answerer: Answerer = first_fragments


@dataclass(frozen=True)
class Answer:
    text: str
    sources: list[str]
    traces: DataFrame
    context: str = ""
    rewritten: str = ""
    selected: list[str] = field(default_factory=list)


def _words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w+", text.lower())))


def _keyword_leg(name: str, chunks: DataFrame, text: str) -> fusion.Leg:
    top = bm25.fuzzy_scores(chunks, _words(text), "chunk_id", "chunk_text").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(fusion.LEG_SIZE)
    return fusion.leg(name, top.withColumn("rank", F.expr("row_number() OVER (ORDER BY score DESC, chunk_id)")))


def _vector_leg(name: str, chunks: DataFrame, vector: list[float]) -> fusion.Leg:
    return fusion.leg(name, knn.nearest(chunks.filter("embedding IS NOT NULL"), vector, fusion.LEG_SIZE, key="chunk_id"))


def legs(chunks: DataFrame, context: TenantContext, question: str, providers: Providers, customer: str | None = None) -> tuple[list[fusion.Leg], str]:
    """The legs that apply: no rewritten legs for an unchanged question, none by customer without one, no vectors without a provider."""
    own = scoped(chunks, context)
    new = rewritten(question, providers.rewriter)
    out, vector = [], None
    if providers.embedder is not None:
        try:
            vector = query_vector(question, providers.embedder)
        except Exception:  # noqa: BLE001  without a vector the words still find
            vector = None
    if vector:
        out.append(_vector_leg("knn_original", own, vector))
        if new != question:
            out.append(_vector_leg("knn_rewritten", own, query_vector(new, providers.embedder)))
    out.append(_keyword_leg("bm25_original", own, question))
    if new != question:
        out.append(_keyword_leg("bm25_rewritten", own, new))
    if customer:
        theirs = customer_scoped(chunks, context, customer)
        if vector:
            out.append(_vector_leg("knn_customer", theirs, vector))
        out.append(_keyword_leg("bm25_customer", theirs, question))
    return out, new


def ranked(chunks: DataFrame, context: TenantContext, question: str, providers: Providers = Providers(), customer: str | None = None) -> tuple[DataFrame, str]:
    found, new = legs(chunks, context, question, providers, customer)
    own = scoped(chunks, context)
    return fusion.budgeted(fusion.reranked(fusion.fused(found, own), own, question, reranker=providers.reranker)), new


def answer(chunks: DataFrame, context: TenantContext, question: str, providers: Providers = Providers(), customer: str | None = None) -> Answer:
    """Chunks hold chunk_id, tenant_id, source_type, title, chunk_text, embedding and, for customer legs, customer."""
    rows, new = ranked(chunks, context, question, providers, customer)
    rows = rows.persist()  # CANDIDATES rows
    try:
        made = fusion.prompt(rows, question, customer).first()
        text = made["context"] if made and made["context"] else ""
        trace = chunks.sparkSession.createDataFrame(fusion.traces(rows).collect(), fusion.traces(rows).schema)  # CANDIDATES rows
    finally:
        rows.unpersist()
    return Answer(providers.answerer(question, text), list(made["sources"] or []) if made else [], trace, text, new)
