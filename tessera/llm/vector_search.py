"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors is joined to its nearest neighbours; the graph is cut into parts of equal size so that few
neighbours are separated, and a small network learns from a vector how its neighbours spread over the parts. Every row
is indexed in its most probable part. A query visits as many of its most probable parts as the sample needed to reach
the target recall, and is compared there with every indexed vector in double precision.

Parts are dealt in blocks of candidates against blocks of queries, so a task's memory does not grow with a part, however
many rows a common vector brings into it; each block returns the best few of each query.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows whose vec_id is null.
Vectors of different lengths are searched apart. Very large and very small components count as any other. Equal scores
rank by the smaller vec_id. Rows that repeat a vec_id count once, with the least of their vectors. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columnar import stored

NEAREST = 5
QUERY_STEP = 50
#: Bound of the training sample, in rows.
SAMPLE = 4000
#: Rows of candidates or queries in one block.
BLOCK = 2000
#: Rows of the whole table for each part, between the least and the most parts that the sample supports.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4000, 8, 64
TARGET_RECALL = 0.95


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each unit row, in slices so that no full matrix is held."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 500):
        similarity = x[a : a + 500] @ x.T
        similarity[np.arange(len(similarity)), np.arange(a, a + len(similarity))] = -2
        out[a : a + 500] = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Equal parts of the graph: seeded around spread-out rows, then refined by moves and swaps that keep more edges whole."""
    n = len(x)
    room = -(-n // parts)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(6):
        order = np.argsort(-(x @ centres.T), axis=1)
        free, part[:] = np.full(parts, room), -1
        for choice in range(parts):
            for row in rng.permutation(np.flatnonzero(part < 0)):
                if free[p := order[row, choice]]:
                    part[row] = p
                    free[p] -= 1
        centres = np.array([x[part == p].mean(axis=0) for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    size = np.bincount(part, minlength=parts)
    slack = int(room * 1.05) + 1
    for _ in range(rounds):
        pull = np.zeros((n, parts))
        np.add.at(pull, (source, part[target]), 1)
        np.add.at(pull, (target, part[source]), 1)
        gain = pull - pull[np.arange(n), part][:, None]
        want = gain.argmax(axis=1)
        movers = np.flatnonzero(gain[np.arange(n), want] > 0)
        moved = 0
        for row in movers[np.argsort(-gain[movers, want[movers]], kind="stable")]:
            if size[want[row]] < slack and size[part[row]] > room * 0.8:
                size[want[row]] += 1
                size[part[row]] -= 1
                part[row] = want[row]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer from a unit vector to the probabilities of its parts."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    visits: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.first + self.first_bias, 0) @ self.second + self.second_bias

    @property
    def parts(self) -> int:
        return len(self.second_bias)


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40, batch: int = 128) -> Router:
    """Adam on the cross entropy between the network and the target distributions."""
    weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            h = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (p @ weights[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.003 * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit(sample: np.ndarray, parts: int, neighbours: int = NEAREST, recall: float = TARGET_RECALL, seed: int = 11) -> Router:
    """Partition the sample's graph, learn to route, and count the parts a held-out query must visit."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    fitted, held = x[len(x) // 4 :], x[: len(x) // 4]
    if len(fitted) < 4 * parts or len(held) < 10:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))  # too small to cut: one part
    graph = neighbour_graph(fitted, min(10, len(fitted) - 1))
    part = balanced_parts(fitted, graph, parts, rng)
    target = np.zeros((len(fitted), parts))
    np.add.at(target, (np.repeat(np.arange(len(fitted)), graph.shape[1]), part[graph.reshape(-1)]), 1.0)
    target[np.arange(len(fitted)), part] += graph.shape[1] / 2
    router = train_router(fitted, target / target.sum(axis=1, keepdims=True), rng)
    indexed = router.logits(x).argmax(axis=1)
    nearest = np.argsort(-(held @ x.T), axis=1)[:, 1 : neighbours + 1]
    order = np.argsort(-router.logits(held), axis=1)
    rank = np.argsort(order, axis=1)
    needed = np.take_along_axis(rank, indexed[nearest], axis=1)
    found = [(needed < m).mean() for m in range(1, parts + 1)]
    router.visits = next(m for m, r in enumerate(found, 1) if r >= recall)
    return router


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector of doubles, size) of the rows that take part; of rows that repeat a vec_id the least vector."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    rows = rows.filter(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: no square over- or underflows, and no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest candidates of each query: preselected by one product of matrices, ranked by the exact measure."""
    queries, vectors = scaled(queries), scaled(vectors)
    length = np.sqrt((vectors * vectors).sum(axis=1))
    rough = (queries @ vectors.T) / length / np.sqrt((queries * queries).sum(axis=1))[:, None]
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    bound = np.partition(rough, max(rough.shape[1] - k, 0), axis=1)[:, max(rough.shape[1] - k, 0)]
    out = []
    for q in range(len(query_ids)):
        near = np.flatnonzero((rough[q] >= bound[q] - 1e-9) & np.isfinite(rough[q]))
        own = queries[q]
        score = (vectors[near] * own).sum(axis=1) / (length[near] * np.sqrt((own * own).sum()))
        order = np.lexsort((ids[near], -score))[:k]
        out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[near[order]], "score": score[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def router_of(rows: DataFrame, n: int, k: int, seed: int) -> Router:
    """The router for ``n`` rows of one length, fitted on about ``SAMPLE`` of them."""
    unit_hash = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sorted(rows.select("vec_id", "vector").filter(unit_hash < F.lit(min(1.0, SAMPLE / max(n, 1)))).limit(2 * SAMPLE).collect())  # about SAMPLE rows
    if not drawn:
        return Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    drawn = [drawn[i] for i in np.random.default_rng(seed).permutation(len(drawn))]
    return fit(np.array([r["vector"] for r in drawn]), int(np.clip(n // PART_ROWS, LEAST_PARTS, MOST_PARTS)), k, seed=seed)


def search(vectors: DataFrame, step: int = QUERY_STEP, k: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``step``.

    Vectors of different lengths have no cosine: each length is a search of its own, with a router of its own.
    """
    rows = stored(usable(vectors, id_column, vector_column), "vectors")
    sizes = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()}  # a row for each length
    found = [_searched(rows.filter(F.col("size") == size), n, step, k, seed) for size, n in sizes.items()]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _searched(rows: DataFrame, n: int, step: int, k: int, seed: int) -> DataFrame:
    router = router_of(rows, n, k, seed)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                if router.parts == 1:
                    order = np.zeros((len(part), 1), np.int64)
                else:
                    order = np.argsort(-router.logits(unit(matrix(part.column(1)))), axis=1, kind="stable")
                visits = pa.FixedSizeListArray.from_arrays(pa.array(order[:, : router.visits].reshape(-1).astype(np.int32)), router.visits).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(order[:, 0].astype(np.int32)), visits], ["vec_id", "vector", "part", "visits"])

    indexed = stored(rows.select("vec_id", "vector").mapInArrow(index, "vec_id long, vector array<double>, part int, visits array<int>"), "indexed")
    queries = indexed.filter(F.col("vec_id") % step == 0)
    sizes = indexed.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row for each part
    asked = queries.select(F.explode("visits").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()
    blocks = {r["part"]: -(-r["n"] // BLOCK) for r in sizes}
    turns = {r["part"]: -(-r["n"] // BLOCK) for r in asked}
    numbers = lambda counts: F.array(*(F.lit(counts.get(p, 0)) for p in range(router.parts)))

    def deal(frame: DataFrame, own: dict[int, int], others: dict[int, int], name: str, other: str) -> DataFrame:
        frame = frame.withColumns({"own": F.get(numbers(own), "part"), "others": F.get(numbers(others), "part")}).filter("own > 0 AND others > 0")
        return frame.select("vec_id", "vector", "part", F.expr("cast(pmod(xxhash64(vec_id), own) AS int)").alias(name), F.explode(F.expr("sequence(0, others - 1)")).alias(other))

    left = deal(queries.select("vec_id", "vector", F.explode("visits").alias("part")), turns, blocks, "turn", "block")
    right = deal(indexed.select("vec_id", "vector", "part"), blocks, turns, "block", "turn")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return best(q["vec_id"].to_numpy(), matrix(q["vector"]), c["vec_id"].to_numpy(), matrix(c["vector"]), k)

    keys = ["part", "block", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth row of ``embeddings``."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
