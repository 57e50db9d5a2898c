"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs once to warm up and once to be timed; its whole result is produced and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
HEADLINE = [
    "bm25_topk",
    "bm25_decay",
    "bm25_fuzzy_terms",
    "hits_page",
    "bm25_batch",
    "facet_terms",
    "knn_exact",
    "knn_filtered",
    "knn_batch",
    "rrf_fusion",
    "retrieval_traces",
    "chunk_sentence",
    "index_batch_chunks",
    "fingerprint_dups",
    "changed_docs_anti",
    "upsert_merge",
    "html_text",
    "kg_traverse",
    "kg_neighbors",
    "log_query",
    "rate_admission",
    "session_split",
    "asof_prev",
    "eval_summary",
]


def main() -> None:
    from tessera.catalog import QUERIES
    from tessera.session import local_session
    from tessera.sources import scratch

    spark = local_session(CPUS, CPUS)
    spark.range(1).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    chunks = documents / max(seconds["chunk_sentence"], 1e-9)
    questions = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").count()
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").filter("label = 3").count()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS, "documents_chunked_per_sec": round(chunks), "ms_per_batched_keyword_query": round(1000 * seconds["bm25_batch"] / max(questions, 1), 2), "ms_per_batched_vector_query": round(1000 * seconds["knn_batch"] / max(vectors, 1), 2)}
        )
    )
    sys.stdout.flush()
    scratch.clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
