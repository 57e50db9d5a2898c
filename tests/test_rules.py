import base64
import json

import pytest
from pyspark.sql import functions as F

from tessera.context import TenantContext, scoped, unknown_references
from tessera.functions import extract
from tessera.functions import text as T
from tessera.functions.similarity import matching_ratio
from tessera.operators import bm25, hits, limits
from tessera.operators.registry import advanced
from tessera.sources import retry, state


def test_hint_is_cut_at_function_words(spark):
    rows = spark.createDataFrame([("project for Acme is in terms of development?",), ("errors at Globex Latam prod",), ("nothing",)], "q string")
    found = [r[0] for r in rows.select(extract.customer_hint(F.col("q"))).collect()]
    assert found == ["Acme", "Globex Latam", None]


def test_patterns_end_at_ascii_words_as_in_sql(spark, duck):
    from tessera.catalog.base import text
    from tessera.catalog.texts import first_case

    names = ["test", "test\u00e4 er", "en\u00e4 \u00e4test te", "pre\rprod", "pre\u2028prod on", "pre\nprod", "te\u017ft", "u\u017fer", "_uat uat_", "QA\u00e9", "redi\u017f", "\u212aafka", "testing1 prod2", "", "AE\u017f-12"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, q string")
    found = [tuple(r) for r in rows.orderBy("id").select(extract.env_leftmost(F.col("q")), extract.env_priority(F.col("q")), extract.env_question(F.col("q")).isNotNull(), extract.service(F.col("q")), extract.source_type(F.col("q"))).collect()]
    raw = "nullif(lower(regexp_extract(q, {0}, 1)), '')"
    leftmost = f"CASE {raw.format(text(extract.ENV_LEFTMOST))} WHEN 'production' THEN 'prod' WHEN 'stage' THEN 'staging' WHEN 'uat' THEN 'staging' WHEN 'development' THEN 'dev' ELSE {raw.format(text(extract.ENV_LEFTMOST))} END"
    known = ", ".join(map(text, extract.ENV_QUESTION_NAMES))
    question = f"coalesce(regexp_replace({raw.format(text(extract.ENV_QUESTION))}, 'pre.prod', 'pre-prod') IN ({known}), false)"
    wanted = [duck.execute(f"SELECT {leftmost}, {first_case('q', extract.ENV_PRIORITY)}, {question}, replace({raw.format(text(extract.SERVICE))}, ' ', '-'), {first_case('q', extract.SOURCES)} FROM (SELECT ? AS q)", [n]).fetchone() for n in names]
    assert found == wanted


def test_cached_rows_end_within_a_second(spark, duck, tmp_path):
    from tessera.catalog import ORACLES, QUERIES

    times = ["2024-01-19 12:00:00", "2024-01-19 12:00:00.000001", "2024-01-19 12:00:00.9", "2024-01-19 11:59:59.999999", "2024-01-20 12:00:00", "2024-01-20 12:00:00.1", "2024-01-20 00:00:00"]
    rows = spark.createDataFrame(list(enumerate(times)), "user_id long, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    wanted = duck.execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') {ORACLES['cached_rows']}").fetchall()
    assert sorted(tuple(r) for r in QUERIES["cached_rows"](spark, str(tmp_path)).collect()) == sorted(wanted) == [(1, 1), (2, 1), (4, 1), (6, 1)]


def test_tenants_never_mix(spark):
    rows = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", None)], "id string, tenant_id string")
    assert [r.id for r in scoped(rows, TenantContext("t1")).collect()] == ["a"]


def test_unknown_references(spark):
    keys = spark.createDataFrame([("k", ["a", "zzz", "*"])], "api_key string, allowed array<string>")
    assert [tuple(r) for r in unknown_references(keys, spark.createDataFrame([("a",)], "id string")).collect()] == [("k", "zzz")]


def test_pages_by_cursor_are_the_whole_order(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(25)], "doc_id long, score double")
    whole = [r.doc_id for r in rows.orderBy(F.desc("score"), "doc_id").collect()]
    seen, cursor = [], None
    while True:
        page = hits.page(rows, 10, cursor=cursor).collect()
        seen += [r.doc_id for r in page]
        cursor = hits.next_cursor(page, 10)
        if cursor is None:
            break
    assert seen == whole


def test_cursors():
    text = base64.urlsafe_b64encode(json.dumps(["1.5", "7"]).encode()).decode().rstrip("=")
    assert hits.read_cursor(text) == ["1.5", "7"]
    for bad in ("!!", "e30", base64.urlsafe_b64encode(b'["x","y"]').decode(), ""):
        assert hits.read_cursor(bad) == []
    assert hits.next_cursor([{"score": 1.0, "doc_id": 2}], 2) is None


def test_sliding_window_edges():
    own = limits.SlidingWindow(2, 1000)
    assert [own.admit(t) for t in (0, 1, 2, 1000, 1001, 1001)] == [True, True, False, True, True, False]


def test_sliding_window_holds_on_any_input():
    import random

    rnd = random.Random(3)
    for _ in range(50):
        times = sorted(rnd.randint(0, 5000) for _ in range(100))
        own = limits.SlidingWindow(5, 1000)
        admitted = [t for t in times if own.admit(t)]
        assert all(sum(t - 1000 < a <= t for a in admitted) <= 5 for t in times)


def test_batch_fold_is_the_loop(spark):
    import random

    rnd = random.Random(4)
    rows = [(rnd.randint(0, 3), i, rnd.randint(0, 20_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    found = {(r.user_id, r.event_id): r.admitted for r in limits.sliding_admission(df, 3, 1000).collect()}
    folds = {u: limits.SlidingWindow(3, 1000) for u in range(4)}
    assert found == {(u, e): folds[u].admit(t) for u, e, t in sorted(rows, key=lambda r: (r[0], r[2], r[1]))}


def test_token_bucket_and_breaker():
    own = limits.TokenBucket(1, 2)
    assert [own.admit(t) for t in (0, 0, 0, 1000, 1000)] == [True, True, False, True, False]
    own = limits.CircuitBreaker()
    states = [own.call(i, True) for i in range(10)] + [own.call(20, True)] + [own.call(30_009 + i, False) for i in range(3)] + [own.call(40_000, False)]
    assert states == ["closed"] * 10 + ["rejected"] + ["half_open"] * 3 + ["closed"]


def test_retries_end(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)] + [(None,)], "retry_count int")
    out = sorted((r.target, r.retry_count, r.retry_after) for r in retry.routed(rows, F.lit(0)).collect() if r.target != "dlq")
    assert out == [("retry-1", 1, 300_000), ("retry-1", 1, 300_000), ("retry-2", 2, 1_800_000), ("retry-3", 3, 7_200_000)]


def test_lifecycle_never_goes_back(spark):
    stages = ["solution", "dev", "testing", "staging", "prod"]
    rows = spark.createDataFrame([(a, b) for a in stages for b in stages], "a string, b string")
    for a, b, c in rows.select("a", "b", advanced(F.col("a"), F.col("b"))).collect():
        assert stages.index(c) == max(stages.index(a), stages.index(b))


def test_ratio_and_fuzziness(spark):
    assert spark.createDataFrame([("acme", "acne"), ("", None)], "a string, b string").select(matching_ratio("a", "b")).collect()[0][0] == 0.75
    assert [bm25.edits(t) for t in ("ab", "abc", "abcde", "abcdef")] == [0, 1, 1, 2]


def test_highlights(spark):
    text = "first words here. " * 20 + "the license of this software. " + "more words. " * 20
    row = spark.createDataFrame([(text,), ("nothing",)], "t string").select(bm25.highlights(F.col("t"), ["license"])).collect()
    assert len(row[0][0]) == 1 and "<em>license</em>" in row[0][0][0] and len(row[0][0][0]) <= 150 + 9
    assert row[1][0] == []


def test_state_is_swapped(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    state.replace_table(state.rows(spark, {"a": "1"}), path)
    state.replace_table(state.updated(spark.read.parquet(path), state.rows(spark, {"a": "2", "b": "3"})), path)
    assert {r.key: r.value for r in spark.read.parquet(path).collect()} == {"a": "2", "b": "3"}


def test_tree_text():
    from tessera.functions.text import tree_text

    cell = lambda *parts: {"type": "tableCell", "content": [{"type": "paragraph", "content": [{"type": "text", "text": p} for p in parts]}]}
    tree = {
        "type": "doc",
        "content": [
            {"type": "heading", "content": [{"type": "text", "text": "Top"}]},
            {"type": "codeBlock", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]},
            {"type": "table", "content": [{"content": [cell("x", "y"), cell(" z ")]}, {"content": [cell("q")]}, {"content": None}]},
            {"type": "orderedList", "content": [{"type": "listItem", "content": [{"type": "text", "text": "one"}, {"type": "hardBreak"}]}, 7, "s", None]},
            {"type": "panel", "content": [{"type": "text", "text": None}, {"type": "rule"}]},
        ],
    }
    assert tree_text(json.dumps(tree)) == "Top\n" + "\n```\nab\n```\n" + "xy | z\nq\n\n" + "• one\n\n• • • " + "\n"
    deep = '{"type":"panel","content":[' * 400 + '{"type":"text","text":"in"}' + "]}" * 400
    assert tree_text(deep) == "in" and [tree_text(t) for t in (None, "", "[1]", "7", "{", '{"type":"table"}')] == ["", "", "", "", "", "\n"]


def test_resolution_does_not_depend_on_the_size_of_the_registry(spark, monkeypatch):
    """All phrases meet all customers, whatever the number of blocks; the best are those of the full product."""
    from difflib import SequenceMatcher

    from tessera.operators import resolve

    customers = [(f"cust-{i}", f"{a}{b} {c}", [f"al {i}"], i) for i, (a, b, c) in enumerate((a, b, c) for a in ("ac", "glo", "ini") for b in ("me", "bex", "tech") for c in ("corp", "gmbh", "llc"))]
    registry = spark.createDataFrame(customers, "id string, name string, aliases array<string>, position int")
    questions = spark.createDataFrame([(1, "status of acmee crp", None), (2, "what about al 7", None), (3, "zzz", None), (4, "globexgmbh", "glotech llc")], "question_id int, question string, hint string")
    outs = []
    for rows in (20_000, 4):
        monkeypatch.setattr(resolve, "BLOCK_ROWS", rows)
        outs.append(sorted(tuple(map(str, r)) for r in resolve.resolved(questions, resolve.scored(questions, registry)).collect()))
    assert outs[0] == outs[1] and len(outs[0]) == 4
    named = {r.question_id: r for r in resolve.resolved(questions, resolve.scored(questions, registry)).collect()}
    assert named[2].customer_id == "cust-7" and named[2].confidence == 1.0
    words = "status of acmee crp".split()
    phrases = [" ".join(words[i:j]) for i in range(4) for j in range(i + 1, 5)]
    best = max(SequenceMatcher(None, p, x).ratio() for p in phrases for _, name, _, _ in customers for x in (name,))
    assert abs(named[1].confidence - best) < 1e-6


@pytest.mark.parametrize("sizes", [(2_000, 5_000), (5, 7)])
def test_resolution_equals_the_full_product(spark, monkeypatch, sizes):
    """Bounds leave out no customer that the comparison of every phrase with every customer would choose."""
    import random
    from difflib import SequenceMatcher

    from tessera.operators import resolve

    monkeypatch.setattr(resolve, "BLOCK_ROWS", sizes[0])
    monkeypatch.setattr(resolve, "PHRASE_ROWS", sizes[1])
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeo01") for _ in range(rng.randint(1, 6)))
    customers = [(f"{word()}-{word()}-{i}", f"{word()} {word()} {word()}"[: rng.randint(3, 18)], [word(), None] if i % 3 else None, rng.randint(0, 9)) for i in range(40)] + [("twin", "same name", [], 1), ("twin-2", "same name", [], 1), ("nameless", None, None, 3)]
    asked = [(i, " ".join(word() for _ in range(rng.randint(0, 5))), f"{word()} {word()}" if i % 4 == 0 else None) for i in range(30)] + [(90, "is same name", None), (91, "zzzz qqqq", None), (92, "", None), (93, None, "same"), (94, "Same Name", None)]
    questions = spark.createDataFrame(asked, "question_id int, question string, hint string")
    registry = spark.createDataFrame(customers, "id string, name string, aliases array<string>, position int")
    found = {r.question_id: r for r in resolve.resolved(questions, resolve.scored(questions, registry)).collect()}
    assert set(found) == {i for i, _, _ in asked}
    phrases = {}
    for r in resolve.phrases(questions).collect():
        phrases.setdefault(r.question_id, []).append(" ".join(r.phrase.lower().split()))

    def score(phrase, own_id, name, aliases):
        own = [" ".join(x.lower().split()) for x in (own_id.replace("-", " "), name or "")]
        overlap = lambda x: len(set(phrase.split()) & set(x.split())) / len(set(phrase.split()) | set(x.split()))
        return 1.0 if phrase in (aliases or []) else max(max(SequenceMatcher(None, phrase, x).ratio(), overlap(x)) for x in own)

    for i, _, _ in asked:
        ranked = sorted((-round(max((score(p, c, n, a) for p in phrases.get(i, [])), default=0.0), 6), at, c) for c, n, a, at in customers)
        best = -ranked[0][0]
        assert found[i].confidence == pytest.approx(best if best >= resolve.LOW else 0.0), i
        assert found[i].customer_id == (ranked[0][2] if best >= resolve.MEDIUM else None), i
        if found[i].decision == "ask":
            assert found[i].candidates == [c for s, _, c in ranked[:3] if -s >= resolve.LOW]


def test_batched_vectors_of_odd_rows(spark):
    from tessera.operators import knn

    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (None, [1.0, 1.0])] + [(10 + i, [0.0, 1.0]) for i in range(50)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [3.0])], "question_id long, vector array<double>")
    out = sorted((r.question_id, r["rank"], r.vec_id, r.score) for r in knn.batch_nearest(chunks, queries, 3).collect())
    assert out == [(1, 1, 10, 1.0), (1, 2, 11, 1.0), (1, 3, 12, 1.0), (4, 1, 5, 1.0)]


def test_html_shows_only_what_a_reader_sees(spark):
    """Nested macros, brackets in quoted attributes and comments leak nothing; broken markup is text."""
    pages = {
        "<p>a</p> <ac:structured-macro><ac:structured-macro>x</ac:structured-macro>LEAK</ac:structured-macro><b>b </b>": "a\nb",
        "<a title='x>y' href=\"u>v\">link</a>": "link",
        "one<!-- <b>hidden</b> > -->two": "one\ntwo",
        "<script>var t = '</p>';</script ><STYLE>p{}</STYLE>seen": "seen",
        "a < b &lt;i&gt; &amp;lt; c&nbsp;": "a < b <i> &lt; c",
        "<ac:structured-macro ac:name='toc' />kept<ac:structured-macro>open to the end": "kept",
        "</ac:structured-macro>kept</p>": "kept",
        "broken <a href='x": "broken\n<\na href='x",
        "<!DOCTYPE html><?xml v?>  \n <br/>": "",
        "": "",
        "line\n  two": "line\n  two",
        "<ac:structured-macro>" * 30 + "in" + "</ac:structured-macro>" * 30 + "out" + "<i>x</i>" * 2000: "out" + "\nx" * 2000,
        "<p " + " ".join(f"a{i}='v>{i}'" for i in range(5000)) + ">t" + "< " * 3000: "t" + ("< " * 3000).strip(),
    }
    rows = spark.createDataFrame([(i, html) for i, html in enumerate([*pages, None])], "id int, html string").select("id", T.html_to_text(F.col("html")).alias("text")).collect()
    assert [r.text for r in sorted(rows)] == [*pages.values(), None]


def test_exchanged_neighbours_are_one_edit(spark):
    pairs = [("wrod", "word"), ("word", "wrod"), ("abcd", "badc"), ("axb", "ba"), ("ca", "abc"), ("same", "same"), ("a", "b"), ("", "ab"), ("kitten", "sitting"), ("abcdef", "bacdfe"), ("éa", "aé")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", bm25.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in rows] == [1, 1, 2, 2, 2, 0, 1, 2, 3, 2, 1]
    vocabulary = spark.createDataFrame([("word", 5), ("wrod", 1), ("lord", 9), ("sword", 2), ("swordfish", 3)], "term string, df long")
    near = {(r.query_term, r.term): r.distance for r in bm25.nearest_terms(vocabulary, ["wrod", "owrd", "to"]).collect()}
    assert near == {("wrod", "wrod"): 0, ("wrod", "word"): 1, ("owrd", "word"): 1}


def test_a_long_question_compares_few_of_its_pairs(monkeypatch):
    """Of all phrases and names of a question, only those are compared whose bound may bring a customer among the best; those are right."""
    import random
    from difflib import SequenceMatcher

    import pyarrow as pa

    from tessera.operators import resolve

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8)))
    words, names = [word() for _ in range(300)], [f"{word()} {word()}" for _ in range(30)] + ["x" * 70, ""]
    phrases = [" ".join(words[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1)]
    asked = pa.table({"question_id": pa.array([5, 6], pa.int32()), "phrases": [[{"phrase": p, "plain": None, "is_hint": False} for p in phrases], []]})
    registry = pa.Table.from_pylist([{"customer_id": f"c{i}", "name": n, "position": i, "own_id": f"c{i}", "own_name": n, "own_aliases": []} for i, n in enumerate(names)])
    calls, ratio = [], resolve._Block.ratio
    monkeypatch.setattr(resolve._Block, "ratio", lambda *a: calls.append(a) or ratio(*a))
    outs = []
    for size in (1 << 21, 4096):
        monkeypatch.setattr(resolve, "_BOUNDS", size)
        outs.append(sorted((-round(r["score"], 6), r["position"]) for r in resolve._best_of_block(asked, registry).to_pylist() if r["question_id"] == 5)[:3])
    share = lambda p, n: len(set(p.split()) & set(n.split())) / len(set(p.split()) | set(n.split()))
    exact = [max(max(SequenceMatcher(None, p, n).ratio(), share(p, n), SequenceMatcher(None, p, f"c{i}").ratio()) for p in phrases) for i, n in enumerate(names)]
    assert outs == [sorted((-round(s, 6), i) for i, s in enumerate(exact))[:3]] * 2
    assert len(calls) < 2 * len(phrases) * 2 * len(names) / 50
