import json
import tarfile

from conftest import DATA, sample_registry
from pyspark.sql import functions as F

from tessera.catalog.base import docs
from tessera.catalog.records import logs
from tessera.context import TenantContext, create_tenants
from tessera.functions.chunking import chunked
from tessera.functions.embedding import BATCH, embedded, hashed_words
from tessera.operators import evaluate
from tessera.operators import logs as L
from tessera.plans import agent, answer, sync
from tessera.schemas import INDEXING_EVENT, TENANT, TIERS
from tessera.sources import config, connectors, documents
from tessera.streaming import indexing, retries, stateful


def chunk_table(spark):
    own = docs(spark, DATA)
    pieces = chunked(own, "sentence").join(own.select("doc_id", "tenant_id", "source_type", "title", F.col("source").alias("customer")), "doc_id")
    return embedded(pieces.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")), "chunk_text", lambda t: hashed_words(t, 64)).persist()


def test_answer_uses_all_legs_and_one_tenant(spark):
    chunks = chunk_table(spark)
    providers = answer.Providers(embedder=lambda t: hashed_words(t, 64))
    made = answer.answer(chunks, TenantContext("acme"), "license version uat", providers, customer="src3")
    rows = made.traces.collect()
    assert 0 < len(rows) <= 30 and sum(r.included for r in rows) <= 6 and made.sources
    own = {r.chunk_id for r in chunks.filter("tenant_id = 'acme'").select("chunk_id").collect()}
    assert {r.chunk_id for r in rows} <= own
    assert made.context.startswith("Customer: src3\nQuestion: license version uat") and made.rewritten.endswith("staging")
    found, _ = answer.legs(chunks, TenantContext("acme"), "license", answer.Providers(embedder=None, rewriter=None))
    assert [x.number for x in found] == [3]

    def broken(_):
        raise RuntimeError

    found, _ = answer.legs(chunks, TenantContext("acme"), "license", answer.Providers(embedder=broken, rewriter=broken), "src3")
    assert [x.number for x in found] == [3, 6]


def test_rewriting_guards():
    assert answer.rewritten("GM-12", lambda q: "x") == "GM-12"
    assert answer.rewritten("why", lambda q: " ") == "why" == answer.rewritten("why", lambda q: "y" * 99)


def test_embedding_batches_fail_alone(spark):
    def provider(texts):
        assert len(texts) <= BATCH
        if "bad" in texts:
            raise RuntimeError
        return hashed_words(texts, 8)

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"w{i}") for i in range(120)], "id int, t string").coalesce(1)
    out = embedded(rows, "t", provider).collect()
    assert sum(r.embedding is None for r in out) == 50 and all(r.embedding_version for r in out)


def test_conversation(spark):
    customers = sample_registry(spark)
    tools = agent.Registry()
    tools.add("search", lambda customer, env, question: docs(spark, DATA).limit(2)).add("logs", lambda customer, env, question: L.newest(logs(spark, DATA), 3)).add("pods", lambda **_: 1 / 0)
    session = agent.Session()
    made = agent.turn(spark, session, "error logs for Acme Corp prod", customers, ["*"], tools, now=1.0)
    assert made.kind == "answer" and made.tools == ["logs", "pods", "search"] and session.customer == "acme" and session.env == "prod"
    assert len(made.results["logs"]) == 3 and "division" in made.results["pods"][0]
    assert agent.turn(spark, agent.Session(), "error logs for Acme Corp prod", customers, ["globex"], tools, now=1.0).kind == "refuse"
    assert agent.turn(spark, agent.Session(), "hello", customers, ["*"], tools, now=1.0).tools == ["search"]
    session.pending, session.candidates = "choose", ["acme", "globex"]
    assert agent.turn(spark, session, "2", customers, ["*"], tools, now=2.0).text == "Using globex."
    assert session.expired(2.0 + 1801) and not session.expired(3.0)


def test_sync_cycles(spark):
    when = lambda s: F.lit(s).cast("timestamp")
    items = spark.createDataFrame([("1", "a", "x", "2024-01-01 00:00:00"), ("2", "b", "y", "2024-01-02 00:00:00")], "source_id string, title string, content string, updated string").withColumn("updated", F.col("updated").cast("timestamp"))
    none = spark.createDataFrame([], "doc_id string, tenant_id string, title string, content string, updated timestamp")
    chunks = spark.createDataFrame([], "doc_id string, chunk_index int")
    tracking = spark.createDataFrame([], "source_id string, source_type string, tenant_id string, doc_id string, last_seen_at timestamp")
    state = spark.createDataFrame([], "key string, value string")
    first = sync.synced(items, none, chunks, tracking, state, "t", "jira", None, when("2024-02-01"))
    assert first.documents.count() == 2 and first.tracking.count() == 2
    delta = sync.synced(items, first.documents, chunks, first.tracking, first.state, "t", "jira", when("2024-01-02 00:00:30"), when("2024-02-02"))
    assert delta.documents.count() == 2 and delta.tracking.count() == 2  # a delta cycle purges nothing
    again = sync.synced(items.filter("source_id = '2'"), delta.documents, chunks, delta.tracking, delta.state, "t", "jira", None, when("2024-02-03"))
    assert [r.title for r in again.documents.collect()] == ["b"] and again.tracking.count() == 1
    assert again.state.count() == 1


def test_creating_and_deleting(spark):
    context = TenantContext("t", roles=frozenset({"EDITOR"}))
    tenants = spark.createDataFrame([("t", 2)], "id string, quota_docs long")
    requests = spark.createDataFrame([("s", "1", "title", "content", {}), ("s", "2", " ", "content", {}), ("s", None, "t", None, {})], "source string, source_id string, title string, content string, metadata map<string,string>")
    own = spark.createDataFrame([("d1", "t")], "doc_id string, tenant_id string")
    good, bad = documents.created(requests, own, tenants, context, F.current_timestamp())
    assert [r.title for r in good.collect()] == ["title"] and sorted(r.reason for r in bad.collect()) == ["content", "title"]
    assert documents.events(good).columns == [c.strip().split(" ")[0] for c in INDEXING_EVENT.split(", ")]
    full = spark.createDataFrame([("d1", "t"), ("d2", "t")], "doc_id string, tenant_id string")
    assert documents.created(requests, full, tenants, context, F.current_timestamp())[0].count() == 0
    assert documents.created(requests, own, tenants, TenantContext("t"), F.current_timestamp())[0].count() == 0
    left, pieces = documents.deleted(full, full.withColumn("chunk_index", F.lit(0)), spark.createDataFrame([("d1",), ("other",)], "doc_id string"), context)
    assert left.count() == 1 and pieces.count() == 1
    assert documents.seed(spark, ["a", "b"]).count() == 10


def test_files(spark, tmp_path):
    for name, text in {"a.py": "def f():\n  pass", "node_modules/x.py": "no", "docs/adr/1.md": "# d", "b.bin": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = connectors.read_tree(spark, f"file://{tmp_path}").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["1.md", "a.py"]
    with tarfile.open(tmp_path / "repo.tar.gz", "w:gz") as archive:
        for name in ("a.py", "node_modules/x.py", "docs/adr/1.md", "b.bin"):
            archive.add(tmp_path / name, name)
    rows = connectors.read_archives(spark, f"file://{tmp_path}/*.tar.gz").collect()
    assert sorted((r.path, r.text) for r in rows) == [("a.py", "def f():\n  pass"), ("docs/adr/1.md", "# d")]


def test_configuration(spark, tmp_path):
    (tmp_path / "p.yml").write_text(json.dumps({"products": {"wms": {"priority": "high", "repos": ["a"]}, "rdc": None}}))
    assert sorted((r.id, r.priority) for r in config.products(spark, f"file://{tmp_path}/p.yml").collect()) == [("rdc", None), ("wms", "high")]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "acme", "name": "Acme", "environments": {"prod": {"k": "v"}}}]))
    own = config.registry(spark, f"file://{tmp_path}/c.json")
    config.save_registry(own, f"file://{tmp_path}/registry")
    assert [r.environments for r in spark.read.parquet(f"file://{tmp_path}/registry").collect()] == [{"prod": {"k": "v"}}]
    (tmp_path / "e.json").write_text(json.dumps([{"id": "1", "question": "q", "expected_sources": ["a"], "expected_answer_keywords": []}]))
    items = evaluate.read_items(spark, f"file://{tmp_path}/e.json")
    evaluate.write_results(items.select("id"), f"file://{tmp_path}/results", "r1")
    assert spark.read.json(f"file://{tmp_path}/results").first().run == "r1"


def test_custom_field_values(spark):
    rows = spark.createDataFrame([('[{"value":"EU"},{"name":"n"},"x"]',), ('{"displayName":"Ann"}',), ("5",), ('"s"',), ("null",), (None,)], "v string")
    assert [r[0] for r in rows.select(connectors.field_values(F.col("v"))).collect()] == [["EU", "n", "x"], ["Ann"], ["5"], ["s"], [], []]


def test_tenants_are_created(spark):
    own = spark.createDataFrame([("acme", "Acme", "FREE", 5, None)], TENANT)
    requests = spark.createDataFrame([("globex", "Globex", "premium", None), ("acme", "Again", "FREE", 1), ("B", "x", "FREE", 1)], "id string, name string, tier string, quota_docs long")
    made, refused = create_tenants(own, requests, list(TIERS), F.current_timestamp())
    assert sorted(r.id for r in made.collect()) == ["acme", "globex"] and sorted(r.id for r in refused.collect()) == ["B", "acme"]


def test_standard_tools(spark):
    from tessera.catalog.records import edges, entities

    chunks = docs(spark, DATA).select(F.col("doc_id").alias("chunk_id"), "tenant_id", F.col("text").alias("chunk_text"))
    pods = spark.createDataFrame([("web-1 0/1 Error 9",)], "line string")
    lines = spark.createDataFrame([("acme", "prod", "api\tr/api:v2\t1/1")], "customer string, env string, line string")
    made = agent.standard_tools(chunks, TenantContext("acme"), logs(spark, DATA), pods, lines, edges(spark, DATA), entities(spark, DATA), sample_registry(spark), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    found = {name: tool(customer="acme", env="prod", question="license version").count() for name, tool in made.tools.items()}
    assert set(found) == {"search", "logs", "pods", "deployments", "graph", "customers"} and found["pods"] == found["deployments"] == found["customers"] == 1


def test_indexing_stream_equals_batch(spark, tmp_path):
    rows = [{"doc_id": str(i % 4), "tenant_id": "t", "tier": "ENTERPRISE" if i % 2 else "FREE", "title": "x", "content": "" if i == 9 else f"text {i}. " * 200, "metadata": {}, "created_at": i, "idempotency_key": str(i)} for i in range(10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.json").write_text("\n".join(map(json.dumps, rows)))
    from tessera.sources.kafka import outgoing, read_event_files

    running = indexing.start(read_event_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), hashed_words, available_now=True)
    running.awaitTermination()
    found = indexing.current(spark.read.parquet(str(tmp_path / "out/documents")), ["doc_id"])
    batch = indexing.processed(spark.createDataFrame(rows, INDEXING_EVENT), None, None, F.lit(0))
    assert sorted((r.doc_id, r.fingerprint) for r in found.collect()) == sorted((r.doc_id, r.fingerprint) for r in batch.documents.collect())
    assert batch.failed.count() == 1 and spark.read.parquet(str(tmp_path / "out/failed")).count() == 1
    assert indexing.processed(spark.createDataFrame(rows, INDEXING_EVENT), batch.documents, None, F.lit(0)).documents.count() == 0
    assert {r.topic for r in outgoing(spark.createDataFrame(rows, INDEXING_EVENT)).collect()} == {"indexing.shared", "indexing.enterprise.t"}


def test_stateful_stream_equals_batch(spark):
    from tessera.catalog import QUERIES

    batch = {(r.user_id, r.event_id): r.admitted for r in QUERIES["rate_admission"](spark, DATA).collect()}
    assert {(r.user_id, r.event_id): r.admitted for r in QUERIES["stream_admission"](spark, DATA).collect()} == batch


def test_streams_plan(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    assert stateful.session_stream(stream).isStreaming and stateful.bucket_stream(stream).isStreaming and stateful.windowed_counts(stream, watermark="1 hour").isStreaming
    assert stateful.deduplicated_stream(stream.withColumn("at", F.col("ts").cast("timestamp")), ["event_id"], "at").isStreaming


def test_republishing(spark):
    rows = spark.createDataFrame([(0, {"retry-count": "0", "x": "1"}, "indexing.shared", 40_000), (3, {"original-topic": "o"}, "retry-3", 10_000)], "retry_count int, headers map<string,string>, topic string, retry_after long")
    out = sorted(retries.republished(rows, F.lit("m" * 300), F.lit(0)).collect(), key=lambda r: r.target)
    assert [(r.target, r.original_topic, len(r.failure_reason)) for r in out] == [("dlq", "o", 256), ("retry-1", "indexing.shared", 256)] and out[1].headers == {"x": "1"}
    due, waiting = retries.split_due(rows, F.lit(0))
    assert due.count() == 1 and waiting.count() == 1


def test_a_traversal_is_one_lazy_plan(spark):
    """Building it starts no job; when it runs, a level's exchange is made once for the level and the next one."""
    from tessera.catalog.records import edges, entities
    from tessera.operators import graph

    links, nodes = edges(spark, DATA), entities(spark, DATA)  # reading footers takes jobs
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = graph.traverse(links, nodes, "acme", "order", "1", 4)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 3
