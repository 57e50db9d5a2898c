"""Exact nearest chunks of a query vector; filters come before the ranking, or after it for parity with post-filters."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x * x)


def nearest(chunks: DataFrame, query: list[float], k: int, where: Column | None = None, post_filter: bool = False, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(key, score, rank) of the k nearest by cosine (the order of L2 on unit vectors); ties go to the smaller key.

    The query is a literal of the plan, the ranking a top-k that each partition does on its own first.
    """
    wanted = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.withColumn("score", F.round(cosine(F.col(vector), wanted), digits))
    if where is not None and not post_filter:
        scored = scored.filter(where)
    top = scored.orderBy(F.desc("score"), key).limit(k)
    if where is not None and post_filter:
        top = top.filter(where)
    return top.withColumn("rank", F.expr(f"row_number() OVER (ORDER BY score DESC, `{key}`)")).select(key, "score", "rank")  # at most k rows


#: Queries that one pass holds as a matrix; more are answered in several passes.
QUERY_BLOCK = 2048
#: Queries of one call: their vectors are collected.
MOST_QUERIES = 65_536


def usable(vector: Column) -> Column:
    """Whether a vector of doubles has a direction: neither null nor empty nor zero, all components finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def batch_nearest(chunks: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(question_id, key, score, rank) for a bounded set of queries (question_id, vector) against all rows.

    The queries travel with the tasks as one matrix (``QUERY_BLOCK`` rows at most each); a batch of rows is one product,
    and only its k best a query leave it, by rounded score and key. Queries and rows without a direction take no part,
    nor do rows of another length than the query's. More than ``MOST_QUERIES`` queries are refused: deal them over calls.
    """
    import numpy as np
    import pyarrow as pa

    wanted = queries.select("question_id", F.col("vector").cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    asked = wanted.limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in one call")
    asked.sort(key=lambda r: len(r["vector"]))
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(key, F.col(vector).cast("array<double>").alias("vector")).filter(F.col(key).isNotNull() & usable(F.col("vector")))
    parts = []
    for block in (own[at : at + QUERY_BLOCK] for _, group in itertools.groupby(asked, lambda r: len(r["vector"])) for own in [list(group)] for at in range(0, len(own), QUERY_BLOCK)):
        ids = np.array([r["question_id"] for r in block])
        matrix = np.array([r["vector"] for r in block])
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)

        def run(batches, ids=ids, matrix=matrix):
            for batch in batches:
                for start in range(0, len(batch), 4096):
                    own = batch.slice(start, 4096)
                    x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                    score = np.round(matrix @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, digits)
                    least = max(score.shape[1] - k, 0)
                    bound = np.partition(score, least, axis=1)[:, least]
                    names = np.array(own.column(0).to_pylist())
                    q, c = [], []
                    for number in range(len(score)):
                        near = np.flatnonzero(score[number] >= bound[number])
                        near = near[np.lexsort((names[near], -score[number, near]))[:k]]
                        q += [number] * len(near)
                        c += near.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), own.column(0).take(pa.array(c, pa.int64())), pa.array(score[q, c])], ["question_id", key, "score"])

        parts.append(rows.filter(F.size("vector") == matrix.shape[1]).mapInArrow(run, f"question_id long, `{key}` {kind}, score double"))
    if not parts:
        return chunks.sparkSession.createDataFrame([], f"question_id long, `{key}` {kind}, score double, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.expr(f"row_number() OVER (PARTITION BY question_id ORDER BY score DESC, `{key}`)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
