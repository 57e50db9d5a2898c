"""The paged source against a service in this process: whole results, failing pages, pushed bounds, a stream with overlap."""

import datetime as dt
import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tessera.operators.upsert import latest
from tessera.sources import paged

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


class Desk:
    """Issues in memory, served by pages."""

    def __init__(self):
        self.items, self.asked, self.fails = [], [], Counter()
        desk = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                query = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query, keep_blank_values=True).items()}
                desk.asked.append(query)
                if desk.fails[query["startAt"]] > 0:
                    desk.fails[query["startAt"]] -= 1
                    self.send_error(503)
                    return
                own = sorted((i for i in desk.items if query["since"] <= i["updated"] and (not query["until"] or i["updated"] <= query["until"])), key=lambda i: (i["updated"], i["id"]))
                at = int(query["startAt"])
                body = {"total": len(own), "newest": max((i["updated"] for i in desk.items), default=None), "items": own[at : at + int(query["maxResults"])]}
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/search"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def put(self, key, second, title):
        self.items = [i for i in self.items if i["id"] != key] + [{"id": key, "updated": paged.instant(EPOCH + dt.timedelta(seconds=second)), "title": title}]


@pytest.fixture
def desk(spark):
    paged.register(spark)
    own = Desk()
    for i in range(95):
        own.put(f"K-{i}", i * 10, f"title {i}")
    yield own
    own.server.shutdown()


def options(reader, desk):
    return reader.format("paged").option("url", desk.url).option("page_size", 7).option("pages_per_task", 3).option("pause_seconds", "0.01")


def test_pages_are_whole_and_a_failed_page_is_asked_again(spark, desk):
    desk.fails["21"] = 2
    rows = options(spark.read, desk).load()
    found = rows.withColumn("title", F.get_json_object("body", "$.title")).withColumn("task", F.spark_partition_id())
    assert {(r.id, r.title) for r in found.collect()} == {(i["id"], i["title"]) for i in desk.items}
    assert found.select("task").distinct().count() == 5 and max(int(q["maxResults"]) for q in desk.asked) == 7
    assert rows.agg(F.max("updated")).first()[0].timestamp() == (EPOCH + dt.timedelta(seconds=940)).timestamp()
    desk.asked.clear()
    assert options(spark.read, desk).option("from", "2024-01-01T00:15:00").load().count() == 5 and {q["since"] for q in desk.asked if q["until"]} == {"2024-01-01T00:15:00.000Z"}
    desk.fails["0"] = 100
    with pytest.raises(Exception, match="503"):
        options(spark.read, desk).option("attempts", 2).load().count()


def test_a_bound_goes_to_the_service(spark, desk):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        bound = "2024-01-01 00:15:00"
        rows = options(spark.read, desk).option("push", "true").load().filter(F.col("updated") >= F.lit(bound).cast("timestamp"))
        desk.asked.clear()
        assert {r.id for r in rows.collect()} == {f"K-{i}" for i in range(90, 95)}
        assert {q["since"] for q in desk.asked if q["until"]} == {"2024-01-01T00:15:00.000Z"}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_a_stream_takes_what_is_new_with_its_overlap(spark, desk, tmp_path):
    def run():
        stream = options(spark.readStream, desk).option("overlap_seconds", 60).load()
        stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 95
    desk.asked.clear()
    desk.put("K-3", 1000, "changed")
    desk.put("LATE", 900, "came late")
    rows = run()
    assert rows.filter("id = 'LATE'").count() == 1  # older than the newest of the first run, within the overlap
    assert {q["since"] for q in desk.asked if q["until"]} == {paged.instant(EPOCH + dt.timedelta(seconds=880))}
    assert rows_of(latest(rows.dropDuplicates(), ["id"], ["updated"]).select("id", F.get_json_object("body", "$.title").alias("title"))) == sorted((i["id"], i["title"]) for i in desk.items)
    count = rows.count()
    assert run().count() == count
