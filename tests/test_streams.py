"""Streams over batches: state that ends, batches that appear whole, unchanged documents that are left alone, folds dealt at gaps."""

import json
import shutil

import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import limits
from tessera.schemas import INDEXING_EVENT
from tessera.streaming import indexing, stateful

REQUESTS = "user_id long, ts timestamp, event_id long"


def requests(spark, rows):
    """(user, milliseconds, number) as requests."""
    return spark.createDataFrame(rows, "user_id long, ms long, event_id long").select("user_id", F.timestamp_millis("ms").alias("ts"), "event_id")


def put(spark, folder, rows):
    requests(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize(
    ("make", "whole"),
    [(lambda s: stateful.admission_stream(s, 2, 1000, late="10 seconds"), lambda r: limits.sliding_admission(r, 2, 1000)), (lambda s: stateful.bucket_stream(s, 1, 2, late="10 seconds"), lambda r: limits.bucket_admission(r, 1, 2))],
)
def test_state_ends_with_the_window(spark, tmp_path, make, whole):
    """Three runs with one checkpoint: decisions are those of one fold, and idle keys leave no state behind."""
    first = [(u, 1_000_000 + 1000 * u + i, 10 * u + i) for u in range(20) for i in range(4)]
    second = [(u, 1_020_000 + 100 * i, 1000 + 10 * u + i) for u in range(3) for i in range(4)]
    third = [(99, 1_090_000, 5000)]
    held = []
    for rows in (first, second, third):
        put(spark, tmp_path / "in", rows)
        running = make(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        running.awaitTermination()
        held.append(running.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] >= 3 and held[-1] == 1  # only the last key, whose window is open
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(whole(requests(spark, first + second + third)))


def test_without_a_bound_nothing_late_is_refused(spark, tmp_path):
    for rows in ([(1, 100_000, 1)], [(1, 5, 2)]):
        put(spark, tmp_path / "in", rows)
        stateful.admission_stream(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), 2).writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5000, 9000)), max_size=60), st.integers(1, 3), st.sampled_from([7, 300, 1000]))
def test_folds_cut_at_gaps_equal_whole_folds(spark, found, limit, window):
    rows = [(user, ms, number) for number, (user, ms) in enumerate(found)]
    for name, own, batch in (("window", lambda: limits.SlidingWindow(limit, window), limits.sliding_admission(requests(spark, rows), limit, window)), ("bucket", lambda: limits.TokenBucket(5, limit), limits.bucket_admission(requests(spark, rows), 5, limit))):
        expected, folds = [], {}
        for user, ms, number in sorted(rows):
            expected.append((user, number, folds.setdefault(user, own()).admit(ms)))
        assert sorted((r.user_id, r.event_id, r.admitted) for r in batch.collect()) == sorted(expected), name


def test_requests_without_a_time_or_key(spark):
    rows = requests(spark, [(1, 5, 1), (1, None, 2), (None, 5, 3), (None, None, 4)])
    assert {r.event_id: r.admitted for r in limits.sliding_admission(rows, 1, 10).collect()} == {1: True, 2: None, 3: True, 4: None}
    calls = limits.breaker_states(rows.withColumn("bad", F.lit(False)), "bad").collect()
    assert {r.event_id: r.state for r in calls} == {1: "closed", 2: None, 3: "closed", 4: None}


def test_one_key_on_all_rows_is_dealt_over_tasks(spark):
    """Bursts of one key, with silence between them, are folded by more than one task."""
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("user_id"), F.timestamp_millis(F.col("id") * 10 + F.floor(F.col("id") / 40) * 5000).alias("ts"), F.col("id").alias("event_id"))
    folded = limits.sliding_admission(rows, 3, 1000).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = {r.task: r.n for r in folded.groupBy("task").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks.values()) == 4000 and len(tasks) > 1 and max(tasks.values()) < 3000
    assert folded.filter("admitted").count() == 100 * 3


def events(spark, folder, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"doc_id": i, "tenant_id": "t", "tier": "FREE", "title": "x", "content": c, "metadata": {}, "created_at": at, "idempotency_key": f"{i}-{at}"}) for i, c, at in rows]
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(lines))


def test_batches_appear_whole_and_unchanged_documents_stay(spark, tmp_path):
    out = tmp_path / "out"

    def run():
        indexing.start(spark.readStream.schema(INDEXING_EVENT).json(str(tmp_path / "in")), str(out), available_now=True).awaitTermination()
        return {(r.doc_id, r.batch) for r in indexing.published(spark, str(out), "chunks").collect()}

    events(spark, tmp_path / "in", [("a", "one", 1), ("b", "two", 1), ("c", "", 1)])
    assert run() == {("a", 0), ("b", 0)}
    events(spark, tmp_path / "in", [("a", "one", 2), ("b", "two  changed", 2)])
    assert run() == {("a", 0), ("b", 0), ("b", 1)}
    events(spark, tmp_path / "in", [("d", "", 3)])
    assert run() == {("a", 0), ("b", 0), ("b", 1)} and {(r.doc_id, r.batch) for r in indexing.published(spark, str(out), "failed").collect()} == {("c", 0), ("d", 2)}
    # a crash between the tables of a batch: its chunks are written, but nobody sees them until the batch is repeated
    shutil.rmtree(out / "batches" / "batch=1")
    shutil.rmtree(out / "documents" / "batch=1")
    assert {(r.doc_id, r.batch) for r in indexing.published(spark, str(out), "chunks").collect()} == {("a", 0), ("b", 0)}
    again = indexing.processed(spark.read.schema(INDEXING_EVENT).json(str(tmp_path / "in" / "1.json")), indexing.last_indexed(spark.read.schema(indexing.KNOWN).parquet(str(out / "documents")), spark.read.schema(INDEXING_EVENT).json(str(tmp_path / "in" / "1.json")), 1), None, F.lit(0))
    indexing.write_batch(again, str(out), 1)
    assert {(r.doc_id, r.batch) for r in indexing.published(spark, str(out), "chunks").collect()} == {("a", 0), ("b", 0), ("b", 1)}
