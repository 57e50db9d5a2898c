"""The neighbour graph against exact search: recall, filters inside the walk, the share of rows a walk meets, odd vectors."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tessera.operators import knn, neighbours

TENTH = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.fixture(scope="module")
def tenth(spark, tmp_path_factory):
    rows = spark.read.parquet(TENTH)
    return rows, neighbours.build(rows, str(tmp_path_factory.mktemp("graph")), keep=["label"])


def recall(found, exact) -> float:
    pairs = lambda df: {(r.question_id, r.vec_id) for r in df.select("question_id", "vec_id").collect()}
    want = pairs(exact)
    return len(pairs(found) & want) / max(len(want), 1)


def test_recall_without_and_with_a_filter(spark, tenth):
    rows, graph = tenth
    asked = rows.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    found = neighbours.search(graph, asked, 10)
    assert recall(found, knn.batch_nearest(rows, asked, 10)) >= 0.95
    assert found.groupBy("question_id").count().filter("count <> 10").count() == 0
    one = {r.vec_id: r.score for r in found.filter("question_id = 0").collect()}
    exact = {r.vec_id: r.score for r in knn.nearest(rows, rows.filter("vec_id = 0").first()["embedding"], 10).collect()}
    assert all(exact.get(k, v) == v for k, v in one.items()) and max(one.values()) == 1.0
    few = neighbours.search(graph, asked, 10, F.col("label") == 3)
    assert recall(few, knn.batch_nearest(rows.filter("label = 3"), asked, 10)) >= 0.95
    assert few.join(rows.filter("label = 3"), "vec_id", "left_anti").count() == 0


def test_a_walk_meets_a_part_of_the_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    own = [(i, (centres[i % 30] + 0.35 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows = spark.createDataFrame(own, "vec_id long, embedding array<float>")
    graph = neighbours.build(rows, str(tmp_path / "graph"))
    asked = rows.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    met = neighbours.walk(graph, asked, width=32)
    per_query = met.groupBy("question_id").count().agg(F.avg("count")).first()[0]
    assert per_query < 3000 / 3
    assert met.groupBy("question_id", "id").count().filter("count > 1").count() == 0
    assert recall(neighbours.search(graph, asked, 10, width=32), knn.batch_nearest(rows, asked, 10)) >= 0.95
    degrees = graph.table("edges").agg(F.max(F.size("near")), F.count("*")).first()
    assert degrees[0] <= 2 * neighbours.DEGREE + 5 * neighbours.LINKS and degrees[1] == 3000


def test_odd_vectors(spark, tmp_path):
    same = [(100 + i, [1.0, 0.0]) for i in range(300)]
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1e200, 1e200]), (None, [1.0, 1.0]), (6, [-1.0, 0.5])]
    rows = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>")
    graph = neighbours.build(rows, str(tmp_path / "graph"))
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [-1.0, 0.4]), (4, [1.0, 2.0, 3.0])], "question_id long, vector array<double>")
    found = {}
    for r in neighbours.search(graph, asked, 3).collect():
        found.setdefault(r.question_id, []).append(r.vec_id)
    assert set(found) == {1, 3} and set(found[1]) <= set(range(100, 400)) and found[3][0] == 6
    none = neighbours.build(rows.limit(0), str(tmp_path / "none"))
    assert neighbours.search(none, asked, 3).count() == 0
    single = neighbours.build(rows.filter("vec_id = 6"), str(tmp_path / "single"))
    assert rows_of(neighbours.search(single, asked, 3).select("question_id", "vec_id")) == [(1, 6), (3, 6)]


def test_a_search_of_one_value_walks_its_graph_alone(spark, tenth, tmp_path):
    rows, _ = tenth
    short = spark.createDataFrame([(9000 + i, [1.0, float(i)], 3) for i in range(80)], "vec_id long, embedding array<float>, label int")
    graph = neighbours.build(rows.unionByName(short), str(tmp_path / "graph"), keep=["label"], within=["label"])
    asked = rows.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    met = neighbours.walk(graph, asked, part=F.col("label") == 3)
    own = rows.filter("label = 3")
    assert met.join(own.withColumnRenamed("vec_id", "id"), "id", "left_anti").count() == 0
    assert recall(neighbours.search(graph, asked, 10, part=F.col("label") == 3), knn.batch_nearest(own, asked, 10)) >= 0.95
    labels = graph.table("nodes").select("id", "label", F.size("vector").alias("n"))
    pairs = graph.table("edges").select("id", F.explode("near").alias("near")).join(labels, "id").join(labels.toDF("near", "other", "m"), "near")
    assert pairs.filter("label <> other OR n <> m").count() == 0 and graph.table("edges").count() == rows.count() + 80


def test_a_search_keeps_the_best_and_no_more(spark, tenth, monkeypatch):
    rows, graph = tenth
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    met = neighbours.walk(graph, asked, width=32)
    tables, store = [], neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, name: (tables.append((name, store(df, name))), tables[-1][1])[1])
    found = neighbours.search(graph, asked, 10, width=32)
    best = met.selectExpr("question_id", "id AS vec_id", "round(score, 6) AS score").selectExpr("*", "row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank").filter("rank <= 10")
    assert rows_of(found) == rows_of(best)
    kept = [t.groupBy("question_id").count().agg(F.max("count")).first()[0] for name, t in tables if name == "seen"]
    assert len(kept) > 2 and max(kept) <= 32 < met.groupBy("question_id").count().agg(F.min("count")).first()[0]


def test_blocks_of_nodes_and_queries_change_nothing(spark, tenth, monkeypatch):
    rows, graph = tenth
    asked = rows.filter("vec_id % 50 = 0").select(F.concat(F.lit("q"), "vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    few = F.col("label") == 3
    whole = rows_of(neighbours.search(graph, asked, 5, few, width=16))
    monkeypatch.setattr(neighbours, "NODES", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "PRODUCTS", 100)
    assert rows_of(neighbours.search(graph, asked, 5, few, width=16)) == whole and len(whole) == 200


def test_what_has_met_does_not_meet_again():
    own = np.random.default_rng(3).normal(size=(9, 4)).astype(np.float32)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    fresh, floor, group = [True] + [False] * 8, [-2.0] * 9, [1] * 5 + [2] * 4
    out = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("score", pa.float32())])
    met = lambda: {(r["id"], r["near"]): r["score"] for r in neighbours._nearest_within(table(), 4, out).to_pylist()}
    table = lambda: pa.table({"id": range(9), "vector": own.tolist(), "__centre": group, "fresh": fresh, "floor": pa.array(floor, pa.float32())})
    pairs = met()
    assert set(pairs) == {p for i in range(1, 5) for p in ((0, i), (i, 0))}
    assert all(abs(s - own[a] @ own[b]) < 1e-6 for (a, b), s in pairs.items())
    floor[0] = sorted(s for (a, _), s in pairs.items() if a == 0)[1] + 1e-4
    assert sum(a == 0 for a, _ in met()) == 2 and sum(b == 0 for _, b in met()) == 4
