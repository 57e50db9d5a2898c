"""Nearest neighbours on a navigable graph: built by neighbour descent, kept as an adjacency table, searched many queries at a time.

    nodes/bucket=    (id, vector, norm, and the columns that filters need)
    edges/bucket=    (id, near): the nearest of a node that were found, nodes that it is nearest to, and a few random ones
    starts           (id, and the columns that filters need): where searches begin

The build starts from random groups of bounded size, all compared, and lets neighbours of a node meet each other until their lists no longer
improve; such a group holds what one node's lists hold at most, so no group grows with the table. Two that have met before do not meet again, and only what
improves a list leaves a meeting. A search keeps the best of each query and, round by round, opens its best nodes;
a filter decides what counts as a result, not where the walk may go. A query ends when nothing
unopened is better than its ``width`` best results, so a stricter filter walks further, in the end everywhere.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tessera.operators.knn import dot, usable
from tessera.sources.scratch import stored

BUCKETS = 32
#: Rows of a random group at the start, nearest ones that a node keeps, candidates that a meeting gives each member.
GROUP, DEGREE, MEETING = 2048, 16, 4
#: Random nodes, about so many, that each node leads to besides: ways between clusters, and to nodes that are near to none.
LINKS = 6
#: Rows whose groups go to one call, about, and likenesses that it holds at once (one group's at least).
MET_ROWS, CELLS = 8192, 1 << 22
#: Rounds of descent at most, and the least gain of the sum of all similarities for another one.
ROUNDS, GAIN = 10, 0.003
#: Nodes where a search begins, results that decide when it ends, nodes that it opens a round (or a quarter of its width).
STARTS, WIDTH, STEP = 32, 64, 16
#: Nodes and queries of a block, and pairs of them that are multiplied at once.
NODES, QUERIES, PRODUCTS = 8192, 1024, 1 << 16


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    path: str
    nodes: StructType

    def table(self, name: str) -> DataFrame:
        kind = self.nodes["id"].dataType
        schemas = {"nodes": self.nodes, "edges": StructType().add("id", kind).add("near", ArrayType(kind)).add("bucket", IntegerType()), "starts": StructType([f for f in self.nodes if f.name != "vector"])}
        return self.spark.read.schema(schemas[name]).parquet(f"{self.path}/{name}")


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _measured(length: str) -> Column:
    """Whether a length is a number that can be divided by: squares of components may be too large or too small for one."""
    return (F.col(length) > 0) & (F.col(length) < float("inf"))


def _nearest_within(table: pa.Table, most: int, out: pa.Schema) -> pa.Table:
    """(id, near, score): the ``most`` nearest of each row among the others of its group, of those that are nearer than its ``floor`` and of
    which one at least is ``fresh``; many small groups are one product."""
    codes = table.column("__centre").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes)
    wide = int(sizes.max())
    if wide < 2:
        return out.empty_table()
    ids, vectors = table.column("id").combine_chunks(), table.column("vector").combine_chunks()
    own = vectors.flatten().to_numpy().astype(np.float32).reshape(len(table), -1)[order]
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    fresh, floor = table.column("fresh").to_numpy()[order], table.column("floor").to_numpy()[order]
    ends = np.cumsum(sizes)
    most, each, found = min(most, wide - 1), max(1, CELLS // wide**2), []
    for at in range(0, len(sizes), each):
        low, n = ends[at] - sizes[at], sizes[at : at + each]
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        here = slice(low, low + len(group))
        rows, x = np.zeros((len(n), wide), np.int64), np.zeros((len(n), wide, own.shape[1]), np.float32)
        new, least = np.zeros((len(n), wide), bool), np.zeros((len(n), wide), np.float32)
        rows[group, place], x[group, place], new[group, place], least[group, place] = order[here], own[here], fresh[here], floor[here]
        s = x @ x.transpose(0, 2, 1)
        there = np.arange(wide) < n[:, None]
        s[~(there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]))] = -2
        s[:, np.arange(wide), np.arange(wide)] = -2
        best = np.argpartition(-s, most - 1, axis=2)[:, :, :most]
        score = np.take_along_axis(s, best, 2)
        g, of, to = np.nonzero((score > -2) & (score > least[:, :, None]))
        found.append((rows[g, of], rows[g, best[g, of, to]], score[g, of, to]))
    of, near, score = map(np.concatenate, zip(*found, strict=True))
    return pa.table([ids.take(pa.array(of)), ids.take(pa.array(near)), pa.array(score)], schema=out)


def _met(rows: DataFrame, calls: int, most: int, kind: str) -> DataFrame:
    """Neighbours found within the groups of (id, part, vector, fresh, floor, __centre), in about ``calls`` calls."""
    own = rows.sparkSession.createDataFrame([], f"id {kind}").toArrow().schema.field("id").type
    arrow = pa.schema([("id", own), ("near", own), ("score", pa.float32())])
    dealt = rows.withColumns({"__size": F.size("vector"), "__call": F.pmod(F.xxhash64("__centre"), F.lit(max(1, calls)))})
    return dealt.groupBy("__size", "__call").applyInArrow(lambda table: _nearest_within(table, most, arrow), f"id {kind}, near {kind}, score float")


def _best(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each node, each once, fresh only if it was not there; the limit also works before the shuffle, so a node in many lists is cheap."""
    once = edges.groupBy("id", "near").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    return once.withColumn("place", F.expr("row_number() OVER (PARTITION BY id ORDER BY score DESC, near)")).filter(F.col("place") <= most).drop("place")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("near").alias("id"), F.col("id").alias("near"), "score", "fresh"))


def build(rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = (), degree: int = DEGREE, within: Sequence[str] = ()) -> Graph:
    """Write the graph of ``rows`` under ``path``. Rows without a direction, or too long or short to measure, take no part; keys are expected once.

    Rows that differ in a column of ``within`` (some of ``keep``) lead nowhere to each other: each value has a graph of its own in the same tables,
    and a search of one value walks that alone. Vectors of different lengths never meet.
    """
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), *keep).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    own = own.withColumns({"norm": F.sqrt(dot(F.col("vector"), F.col("vector"))), "part": F.xxhash64(F.size("vector"), *within), "bucket": _bucket(F.col("id"))}).filter(_measured("norm"))
    own.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/nodes")
    graph = Graph(rows.sparkSession, path, own.schema)
    nodes = graph.table("nodes")
    first = nodes.withColumn("place", F.expr("row_number() OVER (PARTITION BY part ORDER BY xxhash64('start', id), id)")).filter(F.col("place") <= STARTS)
    first.drop("place", "vector").write.mode("overwrite").parquet(f"{path}/starts")
    sizes = stored(nodes.groupBy("part").agg(F.count("*").alias("__n")), "parts")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    plain = nodes.select("id", "part", F.transform("vector", lambda v: (v / F.col("norm")).cast("float")).alias("vector"))

    def dealt(name: str, salt: Column, size: int) -> DataFrame:
        """Rows of each part in random groups of about ``size``."""
        return plain.join(sizes, "part").withColumn(name, F.xxhash64(salt, "part", F.pmod(F.xxhash64(salt, "id"), F.ceil(F.col("__n") / size)))).drop("__n")

    new, none = F.lit(True).alias("fresh"), F.lit(-2.0).cast("float").alias("floor")
    random = [_met(dealt("__centre", F.lit(seed), GROUP).select("*", new, none), -(-total // MET_ROWS), degree, kind) for seed in range(2)]
    edges = stored(_best(random[0].unionByName(random[1]).select("*", new), degree), "edges")
    gained = edges.agg(F.sum("score")).first()[0] or 0.0
    for _ in range(ROUNDS):
        members = _best(_both_ways(edges), 2 * degree).withColumn("moved", F.expr("max(fresh) OVER (PARTITION BY id)")).filter("moved")  # elsewhere all have met
        members = members.select(F.col("id").alias("__centre"), F.col("near").alias("id"), "fresh")
        floors = edges.groupBy("id").agg(F.when(F.count("*") >= degree, F.min("score")).otherwise(none).alias("floor"))
        measured = plain.join(floors.hint("merge"), "id", "left").withColumn("floor", F.coalesce("floor", none))
        met = _met(members.join(measured.hint("merge"), "id"), -(-total * 2 * degree // MET_ROWS), MEETING, kind).select("*", new)
        edges = stored(_best(edges.withColumn("fresh", F.lit(False)).unionByName(met), degree), "edges")
        before, gained = gained, edges.agg(F.sum("score")).first()[0] or 0.0
        if gained - before <= GAIN * abs(before):
            break
    mixed = dealt("__group", F.lit("link"), LINKS).select("id", "__group")
    links = mixed.join(mixed.select(F.col("id").alias("near"), "__group"), "__group").filter("id <> near").select("id", "near")
    near = _best(_both_ways(edges), 2 * degree).select("id", "near").unionByName(links).distinct().groupBy("id").agg(F.collect_list("near").alias("near"))  # twice the degree and the links at most
    near.withColumn("bucket", _bucket(F.col("id"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/edges")
    return graph


def _compared(pairs: pa.Table, vectors: pa.Table, out: pa.Schema) -> pa.Table:
    """(question_id, id, score, passes): the nodes that a block of queries has met in a block of nodes, each once, as near as the query's bound at least."""
    sizes = pc.list_value_length(vectors.column("vector"))
    if len(kinds := pc.unique(sizes)) > 1:  # vectors of different lengths never meet
        return pa.concat_tables([_compared(pairs, vectors.filter(pc.equal(sizes, n)), out) for n in kinds])
    own = vectors.column("node")
    nodes, asked = vectors.filter(own), vectors.filter(pc.invert(own))
    if not len(pairs) or not len(nodes) or not len(asked):
        return out.empty_table()
    unit = lambda table: table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(table), -1) / table.column("length").to_numpy()[:, None]
    ids, near = nodes.column("id").combine_chunks(), pairs.column("near").combine_chunks()
    who = pc.index_in(pairs.column("question_id").combine_chunks(), asked.column("question_id").combine_chunks()).fill_null(-1).to_numpy()
    who = np.repeat(who.astype(np.int64), pc.list_value_length(near).to_numpy())
    what = pc.index_in(near.flatten(), ids).fill_null(-1).to_numpy()
    met = np.zeros((len(asked), len(nodes)), bool)
    known = (who >= 0) & (what >= 0)
    met[who[known], what[known]] = True
    who, what = np.nonzero(met)
    x, y, score = unit(asked), unit(nodes), np.empty(len(who))
    for at in range(0, len(who), PRODUCTS):
        part = slice(at, at + PRODUCTS)
        score[part] = np.einsum("ij,ij->i", x[who[part]], y[what[part]])
    good = score >= asked.column("bound").to_numpy()[who]
    who, what = pa.array(who[good]), pa.array(what[good])
    return pa.table([asked.column("question_id").combine_chunks().take(who), ids.take(what), pa.array(score[good]), nodes.column("passes").combine_chunks().take(what)], schema=out)


def _walked(graph: Graph, queries: DataFrame, where: Column | None, width: int, part: Column | None, whole: bool) -> DataFrame:
    """(question_id, id, score, passes): the nodes that the walk of each query met, or of these (not ``whole``) the ones that may be among its results.

    A node under the bound of a query is not worth opening then or later, as bounds only rise. So a query keeps its ``width`` best and what the
    filter leaves out but is as near, not all it has met; a node that it meets again is compared again. Blocks of queries meet blocks of nodes, so a
    vector moves once for each block it meets and no group grows with the table.
    """
    spark = graph.spark
    asked = queries.select("question_id", F.col("vector").cast("array<double>").alias("vector")).filter(F.col("question_id").isNotNull() & usable(F.col("vector")))
    asked = stored(asked.withColumn("length", F.sqrt(dot(F.col("vector"), F.col("vector")))).filter(_measured("length")), "asked")
    kind, asker = graph.nodes["id"].dataType, asked.schema["question_id"].dataType
    starts = [F.lit(r["id"]).cast(kind) for r in graph.table("starts").filter(F.lit(True) if part is None else part).select("id").collect()]  # STARTS of a part at most
    if not starts:
        return asked.select("question_id", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("passes")).limit(0)
    passes = F.coalesce(functools.reduce(operator.and_, [c for c in (where, part) if c is not None], F.lit(True)), F.lit(False))
    nodes, ways = graph.table("nodes"), graph.table("edges")
    if part is not None:
        nodes = stored(nodes.filter(part), "nodes")
        ways = ways.join(nodes.select("bucket", "id").hint("merge"), ["bucket", "id"], "left_semi")
    blocks = -(-nodes.count() // NODES)
    asks = asked.count()
    asking = max(1, -(-asks // QUERIES), min(-(-spark.sparkContext.defaultParallelism // max(1, blocks)), asks // STEP))
    block = lambda key, n: F.pmod(F.xxhash64(F.lit("block"), key), F.lit(max(1, n))).cast("int")
    near = ways.select("id", F.explode("near").alias("near")).withColumn("block", block(F.col("near"), blocks))
    ways = stored(near.groupBy("id", "block").agg(F.collect_list("near").alias("near")), "ways")
    asked = asked.withColumn("asking", block(F.col("question_id"), asking))
    told = nodes.select(F.lit(True).alias("node"), "id", F.lit(None).cast(asker).alias("question_id"), "vector", F.col("norm").alias("length"), passes.alias("passes"), F.lit(None).cast("double").alias("bound"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("asking"), block(F.col("id"), blocks).alias("block"))
    arrow = spark.createDataFrame([], StructType().add("question_id", asker).add("id", kind).add("score", "double").add("passes", "boolean"))
    out = arrow.toArrow().schema

    def scored(pairs: DataFrame, bounds: DataFrame | None) -> DataFrame:
        """Nodes (question_id, block, near) with their likeness; those of another length than the query are left out."""
        bounded = asked.withColumn("bound", F.lit(-2.0)) if bounds is None else asked.join(bounds.hint("merge"), "question_id")
        wanted = bounded.select(F.lit(False).alias("node"), F.lit(None).cast(kind).alias("id"), "question_id", "vector", "length", F.lit(False).alias("passes"), "bound", "asking", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("block"))
        dealt = pairs.select("question_id", "near", "asking", "block").groupBy("asking", "block")
        return dealt.cogroup(told.unionByName(wanted).groupBy("asking", "block")).applyInArrow(lambda _, a, b: _compared(a, b, out), arrow.schema)

    def placed(rows: DataFrame) -> DataFrame:
        """What each query keeps, with its bound and the turn of the nodes that are opened next."""
        once = rows.repartition("question_id").groupBy("question_id", "id").agg(F.max("score").alias("score"), F.max("passes").alias("passes"), F.max("opened").alias("opened"))
        bound = once.withColumn("place", F.expr("row_number() OVER (PARTITION BY question_id ORDER BY passes DESC, score DESC, id)")).withColumn("bound", F.expr(f"coalesce(max(CASE WHEN passes AND place = {width} THEN score END) OVER (PARTITION BY question_id), -2.0)"))
        kept = bound.withColumn("kept", F.when(F.col("passes"), F.col("place") <= width).otherwise(F.col("score") >= F.col("bound")))
        turns = (kept if whole else kept.filter("kept")).withColumn("worth", F.expr("kept AND NOT opened"))
        turn = turns.withColumn("turn", F.expr("row_number() OVER (PARTITION BY question_id, worth ORDER BY score DESC, id)"))
        return turn.select("question_id", "id", "score", "passes", "opened", "bound", F.expr(f"worth AND turn <= {max(STEP, width // 4)}").alias("now"))

    first = asked.select("question_id", "asking", F.explode(F.array(*starts)).alias("id")).withColumn("block", block(F.col("id"), blocks))
    seen = stored(placed(scored(first.withColumn("near", F.array("id")), None).withColumn("opened", F.lit(False))), "seen")
    while True:
        front = seen.filter("now").select("question_id", "id")
        if front.isEmpty():
            return seen.select("question_id", "id", "score", "passes")
        bounds = seen.filter("now").groupBy("question_id").agg((F.lit(-2.0) if whole else F.max("bound")).alias("bound"))
        pairs = front.join(ways.hint("merge"), "id").withColumn("asking", block(F.col("question_id"), asking))
        known = seen.select("question_id", "id", "score", "passes", (F.col("opened") | F.col("now")).alias("opened"))
        seen = stored(placed(known.unionByName(scored(pairs, bounds).withColumn("opened", F.lit(False)))), "seen")


def walk(graph: Graph, queries: DataFrame, where: Column | None = None, width: int = WIDTH, part: Column | None = None) -> DataFrame:
    """(question_id, id, score, passes): every node that the walk of each query (question_id, vector) met.

    ``part`` is a filter by columns that the graph was built ``within``: the walk begins, and stays, among nodes that pass it.
    """
    return _walked(graph, queries, where, width, part, True)


def search(graph: Graph, queries: DataFrame, k: int, where: Column | None = None, width: int = WIDTH, key: str = "vec_id", digits: int = 6, part: Column | None = None) -> DataFrame:
    """(question_id, key, score, rank): the k nearest that the walks found among nodes that pass ``where``, by rounded cosine, then key."""
    found = _walked(graph, queries, where, max(width, k), part, False).filter("passes").select("question_id", F.col("id").alias(key), F.round("score", digits).alias("score"))
    rank = F.expr(f"row_number() OVER (PARTITION BY question_id ORDER BY score DESC, `{key}`)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
