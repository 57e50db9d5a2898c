"""Connected components of an edge table, by alternating large and small stars over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.columnar import stored

#: Edges for each task: a small edge table is not spread over all shuffle partitions.
TASK_ROWS = 100_000


def _unfinished(edges: DataFrame, tasks: int) -> bool:
    """Whether some node hangs on two others, or on one that hangs itself: no forest of stars yet."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    seen = roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).coalesce(tasks)
    return bool(seen.agg(F.max(F.expr("hangs > 1 OR hangs = 1 AND holds = 1"))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of ``edges`` (a, b; any direction, repeats allowed).

    Each round hangs every neighbour on the least node in reach; it ends when the edges are stars. The least nodes are
    stored before they are joined, so both sides of a join are plain shuffles, which adaptive execution splits where a
    node is hot. Edges stay in tables; the driver sees a count and one flag a round.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    tasks = -(-edges.count() // TASK_ROWS)
    few = lambda df: df.coalesce(max(tasks, 1))
    edges = few(edges)
    while tasks and _unfinished(edges, tasks):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))), "least")
        large = stored(few(few(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()), "large")
        least = stored(few(large.groupBy("a").agg(F.min("b").alias("m"))), "least")
        small = few(large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stored(few(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()), "edges")
    centres = few(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)
