"""The jobs: runs over growing input, repeated batches, days run again, and the registered queries against SQL."""

import datetime as dt
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import DATA, ROOT, plain, rows_of
from pyspark.sql import functions as F

from jobs import index_documents, log_rollup
from jobs.queries import ORACLES, QUERIES
from jobs.settings import configured


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows_of(df) == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert before == {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}


def put(spark, folder: Path, rows: list[tuple]) -> None:
    """One more file of documents."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(str(folder))


def texts(spark, out: Path) -> dict[str, str]:
    return {r.doc_id: r.chunk_text for r in index_documents.current(spark, str(out)).collect()}


def test_only_new_documents_are_indexed(spark, tmp_path):
    """Two runs over growing copies of a table: the second takes new files only, and of them what has changed."""
    own, out = tmp_path / "documents", tmp_path / "index"
    shutil.copytree(f"{DATA}/documents.parquet", own) if Path(f"{DATA}/documents.parquet").is_dir() else (own.mkdir(), shutil.copy(f"{DATA}/documents.parquet", own))
    first = index_documents.run(spark, str(own), str(out))
    n = spark.read.parquet(str(own)).count()
    assert first["batches"] == 1 and first["documents"] + first["failed"] == n
    known = spark.read.parquet(str(own)).filter("doc_id = 7").first()
    put(spark, own, [(7, known.text, known.lang, "src7"), (8, "A new text. Of eight.", "en", "src8"), (900_001, "Neues Blatt.", "de", "src1"), (900_002, " ", "en", "src1"), (900_003, "who?", None, None)])
    second = index_documents.run(spark, str(own), str(out))
    assert second == {"batches": 1, "chunks": 2, "failed": 2, "documents": 2}
    found = texts(spark, out)
    assert found["8"] == "A new text. Of eight.\n\nA new text. Of eight." and found["900001"].endswith("Neues Blatt.") and "7" in found and "900002" not in found
    assert {(r.doc_id, r.failure) for r in index_documents.table(spark, f"{out}/failed", index_documents.FAILED).filter("batch = 1").collect()} == {("900002", "content is empty"), ("900003", "tenant_id is missing")}
    assert index_documents.run(spark, str(own), str(out))["batches"] == 0 and texts(spark, out) == found


def test_a_broken_batch_is_repeated_and_never_seen(spark, tmp_path):
    own, out = tmp_path / "documents", tmp_path / "index"
    put(spark, own, [(1, "one", "en", "s"), (2, "two", "fr", "s")])
    index_documents.run(spark, str(own), str(out))
    put(spark, own, [(2, "two changed", "fr", "s"), (3, "three", "es", "s"), (3, "other", "es", "s"), (3, "three", "es", "s")])
    index_documents.run(spark, str(own), str(out))
    whole = rows_of(index_documents.current(spark, str(out)))
    assert texts(spark, out) == {"1": "one\n\none", "2": "two changed\n\ntwo changed", "3": "three\n\nthree"}
    # as if the second run had died before its documents were written: its pieces count for nothing
    shutil.rmtree(out / "documents" / "batch=1")
    for left in (out / "checkpoint" / "commits").glob("*1*"):
        left.unlink()
    assert texts(spark, out) == {"1": "one\n\none", "2": "two\n\ntwo"}
    assert index_documents.run(spark, str(own), str(out))["documents"] == 2
    assert rows_of(index_documents.current(spark, str(out))) == whole


def test_many_files_come_in_bounded_batches(spark, tmp_path):
    """A file a batch, oldest first: the last version of a document stands, and a run in one batch leaves the same pieces."""
    own = tmp_path / "documents"
    for number, rows in enumerate([[(1, "first", "en", "s"), (2, "two", "en", "s")], [(1, "second", "en", "s")], [(1, "third", "en", "s"), (2, "two", "en", "s")]]):
        put(spark, own / f"part{number}", rows)
        for f in (own / f"part{number}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + number, 1_700_000_000 + number))
    config = configured(index_documents.__file__)
    single = index_documents.run(spark, str(own / "part*"), str(tmp_path / "single"), config | {"files_per_batch": 1})
    assert single["batches"] == 3 and single["documents"] == 4  # the third file's unchanged document is left out
    whole = index_documents.run(spark, str(own / "part*"), str(tmp_path / "whole"), config)
    assert whole["batches"] == 1 and whole["documents"] == 2
    assert texts(spark, tmp_path / "single") == texts(spark, tmp_path / "whole") == {"1": "third\n\nthird", "2": "two\n\ntwo"}


def events(spark, folder: Path, rows: list[tuple]) -> str:
    own = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    own.write.mode("append").parquet(str(folder))
    return str(folder)


def test_a_day_is_run_again_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    path = events(spark, tmp_path / "events", [(i, f"2024-01-0{1 + i % 2} 0{i % 5}:00:00", i % 4, "error" if i % 8 == 0 else "click", 0.0, "{}") for i in range(40)])
    log_rollup.run(spark, path, out)
    before = rows_of(log_rollup.rollup(spark, out))
    log_rollup.run(spark, path, out)
    assert rows_of(log_rollup.rollup(spark, out)) == before
    events(spark, tmp_path / "events", [(100 + i, "2024-01-02 23:30:00", 0, "error", 0.0, "late") for i in range(30)])
    log_rollup.run(spark, path, out, since="2024-01-02", until="2024-01-03")
    rows = log_rollup.rollup(spark, out)
    day = lambda d: F.col("day") == F.lit(dt.date(2024, 1, d))
    assert rows_of(rows.filter(day(1))) == [r for r in before if r[0].endswith("01")]
    late = rows.filter(day(2) & (F.col("grain") == "daily") & (F.col("namespace") == "ns-0")).first()
    assert late.top_error == "error late" and late.top_error_n == 30 and late.regressed and late.previous_share is not None
    whole = str(tmp_path / "whole")
    log_rollup.run(spark, path, whole)
    assert rows_of(log_rollup.rollup(spark, whole)) == rows_of(rows)


def test_no_rows(spark, tmp_path):
    path = events(spark, tmp_path / "events", [])
    assert log_rollup.run(spark, path, str(tmp_path / "out")) == {"hourly": 0, "errors": 0, "daily": 0}
    put(spark, tmp_path / "documents", [])
    assert index_documents.run(spark, str(tmp_path / "documents"), str(tmp_path / "index"))["documents"] == 0
    assert texts(spark, tmp_path / "index") == {}


def test_command_lines(tmp_path):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"top_errors": 1}))
    for job, table in (("log_rollup", "events"), ("index_documents", "documents")):
        args = [sys.executable, "-m", f"jobs.{job}", f"--{table}", f"{DATA}/{table}.parquet", "--out", str(tmp_path / job), *(["--config", str(own)] if job == "log_rollup" else [])]
        done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0 and "done: {" in done.stderr, done.stderr[-2000:]
    assert list((tmp_path / "log_rollup" / "daily").glob("day=*")) and list((tmp_path / "index_documents" / "chunks").glob("batch=0/index_name=*"))
