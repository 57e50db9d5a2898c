"""From ranked legs to an answer's sources: reciprocal-rank fusion, reranking, per-source budget, traces, prompt."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.schemas import authority, budget

RANK_OFFSET, LEG_SIZE, CANDIDATES, SELECTED = 60, 50, 30, 6


@dataclass(frozen=True)
class Leg:
    """One ranked list of hits (key, rank from 1) and what its places weigh."""

    hits: DataFrame
    number: int
    weight: float
    family: str


# Weights of the legs, in the order that breaks ties.
LEG_WEIGHTS = {"knn_original": 1.0, "knn_rewritten": 0.7, "bm25_original": 1.0, "bm25_rewritten": 0.7, "knn_customer": 2.0, "bm25_customer": 2.0}


def leg(name: str, hits: DataFrame) -> Leg:
    return Leg(hits, list(LEG_WEIGHTS).index(name) + 1, LEG_WEIGHTS[name], name.split("_")[0])


def union_of_legs(legs: list[Leg], key: str = "chunk_id") -> DataFrame:
    """One plan for all legs; those that do not apply are simply not given."""
    parts = [x.hits.select(key, "rank", F.lit(x.number).alias("leg"), F.lit(x.weight).alias("weight"), F.lit(x.family).alias("family")) for x in legs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fused(legs: list[Leg], chunks: DataFrame, key: str = "chunk_id", source: str = "source_type", digits: int = 10) -> DataFrame:
    """(key, source, rrf_score, rrf_rank, knn_rank, bm25_rank): summed places, weighted by leg and source authority."""
    hits = union_of_legs(legs, key).join(chunks.select(key, source), key)
    gain = F.col("weight") * authority(F.col(source)) / (F.lit(RANK_OFFSET) + F.col("rank"))
    summed = hits.groupBy(key, source).agg(
        F.round(F.sum(gain), digits).alias("rrf_score"),
        F.min(F.when(F.col("family") == "knn", F.col("rank"))).alias("knn_rank"),
        F.min(F.when(F.col("family") == "bm25", F.col("rank"))).alias("bm25_rank"),
        F.min(F.struct("leg", "rank")).alias("first"),
    )
    order = f"row_number() OVER (ORDER BY rrf_score DESC, first.leg, first.rank, `{key}`)"  # legs hold LEG_SIZE rows each
    return summed.withColumn("rrf_rank", F.expr(order)).drop("first")


Reranker = Callable[[Column, Column], Column]


def lexical_overlap(query_tokens: Column, text: Column) -> Column:
    """The built-in reranker: share of the query's words that the text holds."""
    wanted = F.array_distinct(query_tokens)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wanted, tokens(text))) / F.size(wanted))


def reranked(candidates: DataFrame, chunks: DataFrame, question: str, key: str = "chunk_id", reranker: Reranker | None = lexical_overlap, digits: int = 6) -> DataFrame:
    """The first ``CANDIDATES`` with rerank_score and rerank_rank; without a reranker the fused order stands."""
    top = candidates.filter(F.col("rrf_rank") <= CANDIDATES).join(chunks.select(key, "title", "chunk_text"), key)
    if reranker is None:
        return top.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_rank": F.col("rrf_rank")})
    scored = top.withColumn("rerank_score", F.round(reranker(tokens(F.lit(question)), F.concat_ws("\n", "title", "chunk_text")), digits))
    return scored.withColumn("rerank_rank", F.expr("row_number() OVER (ORDER BY rerank_score DESC NULLS LAST, rrf_rank)"))


def budgeted(ranked: DataFrame, source: str = "source_type", rank: str = "rerank_rank") -> DataFrame:
    """Adds final_rank: picks within each source's budget first, fillers after them, ``SELECTED`` in all; null if left out."""
    place = F.expr(f"row_number() OVER (PARTITION BY `{source}` ORDER BY `{rank}`)")
    marked = ranked.withColumn("filler", place > budget(F.col(source)))
    final = F.expr(f"row_number() OVER (ORDER BY filler, `{rank}`)")
    return marked.withColumn("final_rank", final).withColumn("final_rank", F.when(F.col("final_rank") <= SELECTED, F.col("final_rank"))).drop("filler")


def traces(ranked: DataFrame, key: str = "chunk_id", source: str = "source_type", embedding_version: str = "v1") -> DataFrame:
    columns = [key, source, "knn_rank", "bm25_rank", "rrf_score", "rrf_rank", "rerank_score", "final_rank"]
    return ranked.select(*columns, F.col("final_rank").isNotNull().alias("included"), F.lit(embedding_version).alias("embedding_version"))


def prompt(selected: DataFrame, question: str, customer: str | None = None, source: str = "source_type") -> DataFrame:
    """(context, sources): labelled blocks of the selected chunks in final order, and their distinct sources."""
    block = F.concat(F.lit("["), F.upper(source), F.lit("] "), F.col("title"), F.lit("\n"), F.col("chunk_text"))
    ordered = F.array_sort(F.collect_list(F.struct("final_rank", block.alias("block"), F.col(source).alias("source"))))  # SELECTED rows
    head = f"Customer: {customer}\n" if customer else ""
    return (
        selected.filter("final_rank IS NOT NULL")
        .agg(ordered.alias("rows"))
        .select(
            F.concat(F.lit(f"{head}Question: {question}\n\n"), F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n")).alias("context"),
            F.array_distinct(F.transform("rows", lambda r: r["source"])).alias("sources"),
        )
    )
