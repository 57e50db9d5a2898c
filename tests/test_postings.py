"""Stored postings: scores equal those of the texts, searches skip what can't enter the result, segments replace documents."""

import dataclasses

import pytest
from conftest import DATA, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.catalog.base import keyword_index
from tessera.operators import bm25, postings
from tessera.streaming import indexing

TERMS = ["license", "version", "the", "token", "the", "nowhere"]


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rounded(df):
    return rows_of(df.withColumn("score", F.round("score", 6)))


def table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string")


def test_scores_equal_a_pass_over_the_texts(spark):
    index = keyword_index(spark, DATA)
    assert keyword_index(spark, DATA) is index
    expected = bm25.scores(documents(spark), TERMS)
    assert rounded(postings.scores(index, TERMS)) == rounded(expected)
    assert rows_of(postings.top(index, TERMS, 10).select("doc_id")) == rows_of(expected.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id"))
    assert rows_of(postings.corpus_figures(index, TERMS)) == rows_of(bm25.corpus_figures(documents(spark), TERMS))
    near = ["licence", "vershion"]
    assert rows_of(postings.expansions(index, near)) == rows_of(bm25.expansions(documents(spark), near))
    assert postings.top(index, ["nowhere"], 5).count() == 0 == postings.scores(index, []).count()


def test_only_the_buckets_of_the_terms_are_read(spark):
    plan = postings.scores(keyword_index(spark, DATA), ["license"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan and "documents.parquet" not in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,license)" in plan
    sizes = postings.frequencies(keyword_index(spark, DATA), postings.blocks(keyword_index(spark, DATA), ["license"]))._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in sizes.split("ReadSchema:")[1].splitlines()[0]


def test_a_search_skips_ranges_that_cannot_enter(spark, tmp_path, monkeypatch):
    """Small ranges: few of them are read beyond the seeds, and the k best are those of all texts."""
    monkeypatch.setattr(postings, "RANGE_DOCS", 4)
    rows = [(i, ("rare " if i % 97 == 0 else "") + "common " * (1 + i % 3) + "filler " * (i % 50)) for i in range(600)]
    index = postings.append(table(spark, rows), str(tmp_path / "index"), 0)
    assert index.ranges > max(10 * postings.SEEDS, postings.MANY_RANGES)
    for terms in (["rare", "common"], ["common"], ["rare"], ["filler", "common", "common"]):
        expected = bm25.scores(table(spark, rows), terms).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(5)
        assert [tuple(r) for r in postings.top(index, terms, 5).collect()] == [tuple(r) for r in expected.collect()]
    own = postings.blocks(index, ["rare", "common"])
    weights = postings._weighed(index, ["rare", "common"], own)
    bound = postings.bounds(index, own, weights)
    best = postings._summed(index, own, weights).orderBy(F.desc("score")).limit(5).agg(F.min("score")).first()[0]
    assert 0 < bound.filter(F.col("bound") >= best).count() < bound.count() / 4
    real = postings._entries(index, own).groupBy("segment", "range", "id").agg(F.sum(postings._part(weights, F.col("tf"), F.col("dl"), index.avgdl)).alias("score"))
    assert real.join(bound, ["segment", "range"]).filter("score > bound + 1e-9").count() == 0


def test_segments_replace_documents(spark, tmp_path):
    """After each segment, and after compaction, the index is that of the texts as they stand."""
    path = str(tmp_path / "index")
    versions = [
        [(1, "a b c"), (2, "a a d"), (3, None), (4, "b " * 50), (5, "é ünï a")],
        [(2, "d e e"), (6, "a"), (3, "now a text")],
        [(2, ""), (7, "a b"), (1, "z a")],
        [],
    ]
    state: dict = {}
    for segment, rows in enumerate(versions):
        state |= dict(rows)
        index = postings.append(table(spark, rows), path, segment)
        again = postings.append(table(spark, rows), path, segment)  # a repeated segment changes nothing
        assert (index.n, index.words, index.segments) == (again.n, again.words, again.segments) and index.n == len(state)
        now = table(spark, list(state.items()))
        for own in (again, postings.compacted(again, str(tmp_path / f"compact{segment}"))):
            assert rounded(postings.scores(own, ["a", "b", "e"])) == rounded(bm25.scores(now, ["a", "b", "e"]))
            assert rows_of(postings.top(own, ["a", "d"], 3).select("doc_id")) == rows_of(bm25.scores(now, ["a", "d"]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(3).select("doc_id"))
            asked = spark.createDataFrame([(1, "a b a"), (2, "e"), (3, "none"), (4, None)], "question_id int, question string")
            assert rounded(postings.batch_scores(own, asked)) == rounded(bm25.batch_scores(now, asked))
            assert {r.term for r in postings.vocabulary(own).collect()} == {w for t in state.values() for w in (t or "").split()}
        assert own.segments == (0,) and not own.any_dead
    # a segment without figures is not there
    hidden = dataclasses.replace(again, segments=(0,))
    assert {r.doc_id for r in postings.scores(hidden, ["e"]).collect()} == set()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab É", max_size=30), max_size=30), st.lists(st.sampled_from(["a", "b", "é", "ab", "ba"]), max_size=3))
def test_any_texts(spark, tmp_path_factory, texts, terms):
    docs = table(spark, [(f"d{i}", t) for i, t in enumerate(texts)], "string")
    index = postings.append(docs, str(tmp_path_factory.mktemp("index")), 0)
    assert rounded(postings.scores(index, terms)) == rounded(bm25.scores(docs, terms))


def test_the_stream_keeps_the_index_up(spark, tmp_path):
    """The second batch replaces a document; the search then finds its new words only."""
    schema = "doc_id string, tenant_id string, tier string, title string, content string, metadata map<string,string>, created_at long, idempotency_key string"
    folder, out = tmp_path / "events", tmp_path / "out"

    def put(rows):
        spark.createDataFrame([(i, "t", "FREE", "title", c, None, at, i) for i, c, at in rows], schema).coalesce(1).write.mode("append").json(str(folder))
        indexing.start(spark.readStream.schema(schema).json(str(folder)), str(out), available_now=True, keywords=str(tmp_path / "index")).awaitTermination()
        return postings.opened(spark, str(tmp_path / "index"), "string")

    index = put([("a", "old words here", 1), ("b", "other words", 1)])
    assert {r.doc_id for r in postings.scores(index, ["words"]).collect()} == {"a", "b"}
    index = put([("a", "fresh text", 2)])
    assert {r.doc_id for r in postings.scores(index, ["words"]).collect()} == {"b"}
    assert {r.doc_id for r in postings.top(index, ["fresh", "title"], 1).collect()} == {"a"} and index.n == 2


@pytest.mark.parametrize("terms", [["the"], ["license", "version", "the", "token"]])
def test_top_is_the_head_of_all_scores(spark, terms):
    index = keyword_index(spark, DATA)
    own = postings.scores(index, terms).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id")
    assert [tuple(r) for r in postings.top(index, terms, 30).collect()] == [tuple(r) for r in own.limit(30).collect()]


def test_a_build_moves_its_documents_once(spark, tmp_path, monkeypatch):
    """Counted documents are dealt by range, blocks are made and written there; repeated keys, null ones too, count once."""
    plans, write = {}, postings.replace_partitions

    def kept(rows, path, *by):
        plans[path.rsplit("/", 1)[1]] = rows._jdf.queryExecution().executedPlan().toString()
        write(rows, path, *by)

    monkeypatch.setattr(postings, "replace_partitions", kept)
    monkeypatch.setattr(postings, "RANGE_WORDS", 50)
    rows = [(i % 40, f"a b{i % 40} c") for i in range(60)] + [(None, "a"), (None, "a"), (50, "a " * 400)]
    index = postings.append(table(spark, rows), str(tmp_path / "index"), 0)
    assert plans["postings"].split("Initial Plan")[-1].count("Exchange ") == 1
    assert index.n == 42 and index.words == 40 * 3 + 1 + 400 and index.ranges >= 10
    assert [r["df"] for r in postings.corpus_figures(index, ["a"]).collect()] == [42]


@pytest.mark.parametrize("dead", [False, True])
def test_best_of_many_questions(spark, tmp_path, monkeypatch, dead):
    """The same documents and scores as all scores ranked, whatever the number of ranges and of questions at a time."""
    monkeypatch.setattr(postings, "RANGE_DOCS", 16)
    monkeypatch.setattr(postings, "QUESTIONS", 2)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 4 + i % 9))) for i in range(200)] + [(1000 + i, "same words w1 w2") for i in range(60)]
    index = postings.append(table(spark, rows), str(tmp_path / "index"), 0)
    if dead:
        index = postings.append(table(spark, [(3, "w1 w5 w5"), (1000, None)]), str(tmp_path / "index"), 1)
    asked = spark.createDataFrame([(1, "w1 w2 same"), (2, "w5 w5 w7 none"), (3, "nowhere"), (4, None), (5, "w0"), (6, "w3 w4 w8 w9")], "question_id int, question string")
    expected = bm25.batch_top(postings.batch_scores(index, asked), 7)
    found = postings.batch_best(index, asked, 7)
    assert found.columns == ["question_id", "doc_id", "score", "rank"] and rows_of(found) == rows_of(expected) and found.count() == 28
    assert postings.batch_best(index, asked.filter("question_id = 4"), 7).count() == 0
