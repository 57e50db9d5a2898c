"""Joins, searches, filters, scans and the pipeline against brute force, with odd inputs and hot groups."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import license_scan, ngram_join, url_filter, vector_search
from tessera.llm.components import components
from tessera.llm.words import text_words

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string, gram int, first long"


def shingles(text: str) -> set[tuple]:
    words = [w.decode() for w in text_words(text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_links(texts: dict[int, str]) -> tuple[dict[int, int], dict[int, int]]:
    """Links and least linked id in reach of every document, over all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders = defaultdict(list)
    for k, own in sets.items():
        for s in own:
            holders[s].append(k)
    common = Counter(p for own in holders.values() for i, a in enumerate(own) for p in ((a, b) for b in own[i + 1 :]))
    links, group = Counter(), {k: k for k in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for (a, b), n in common.items():
        if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    return {k: links[k] for k in texts}, {k: root(k) for k in texts}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 9, "k", 1, 2) for i, t in rows], SCHEMA)


# --- 3 near duplicates ---------------------------------------------------------------------------------------------


def test_join_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    links, group = brute_links(texts)
    out = {r.doc_id: r for r in ngram_join.op3_ngram_join(spark, LARGER).collect()}
    assert set(out) == set(texts) and sum(links.values()) > 100
    assert {k: r.n_links for k, r in out.items()} == links and {k: r.class_id for k, r in out.items()} == group


def test_join_is_its_sql(spark):
    import duckdb

    from tessera.llm.queries import ORACLE_SQL

    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{LARGER}/documents.parquet'")
    result = own.execute(ORACLE_SQL["op3_ngram_join"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall()) == sorted(tuple(r[c] for c in names) for r in ngram_join.op3_ngram_join(spark, LARGER).collect())


def test_join_of_large_groups(spark):
    """Exact copies, and more near copies than a block holds, some linked only through others."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, "copied text of a few words that is the same everywhere") for i in range(200)]
    rows += [(2000 + i, " ".join(word() for _ in range(60))) for i in range(50)]
    links, group = brute_links(dict(rows))
    out = {r.doc_id: r for r in ngram_join.join(documents(spark, rows)).collect()}
    assert {k: r.n_links for k, r in out.items()} == links and {k: r.class_id for k, r in out.items()} == group
    assert out[1005].copy_id == 1000 and out[1005].n_links == 199


def test_join_of_odd_rows(spark):
    long = "ein langer satz mit worten " * 40_000
    rows = [(1, None), (2, ""), (3, " .,! "), (4, "two words"), (5, "Two, WORDS!"), (6, long), (7, long + "x"), (8, "one two three four five six"), (8, "one two three four five six"), (None, "two words")]
    out = ngram_join.join(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].n_links for i in (1, 2, 3)] == [0, 0, 0] and [by[i].class_id for i in (1, 2, 3)] == [1, 2, 3]
    assert by[4].class_id == by[5].class_id == 4 and by[4].n_links == 1 and by[7].class_id == 6
    assert by[8].class_id == 8 and by[None].class_id is None and by[None].n_links == 0
    assert ngram_join.join(documents(spark, [])).count() == 0
    kept = ngram_join.near_duplicate_stage(spark, documents(spark, rows), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 2, 3, 4, 6, 8, None])) and kept[0].__fields__ == documents(spark, []).columns


def test_trees_reach_the_target_recall():
    for length in ngram_join.LENGTHS:
        trees = ngram_join.trees_for(length)
        assert 1 - (1 - 0.8**length) ** trees >= ngram_join.TARGET_RECALL > 1 - (1 - 0.8**length) ** (trees - 1)
    rng = np.random.default_rng(1)
    met, equal = Counter(), []
    for _ in range(300):  # measured: pairs at the threshold meet at every length and pass the estimate
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400, 50, 50))
        labels = ngram_join.labels_of([np.concatenate([both, a]), np.concatenate([both, b])])
        equal.append((labels[0] == labels[1]).sum())
        for length in ngram_join.LENGTHS:
            keys = ngram_join.prefix_keys(labels, length)
            met[length] += bool((keys[0] == keys[1]).any())
    assert min(met.values()) >= 298 and min(equal) >= ngram_join.least_equal()
    assert abs(np.mean(equal) / ngram_join.VALUES - 0.8) < 0.01


def test_reach_within_a_node_is_over_all_pairs(monkeypatch):
    """Chains, stars and loners in any order: the sets are those of all pairs that the estimate leaves."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ngram_join, "VALUES", 12)
    bound = ngram_join.least_equal()
    for _ in range(40):
        labels = rng.integers(0, 2, (25, 12)).astype(np.uint16)
        near = (labels[:, None, :] == labels[None, :, :]).sum(axis=2) >= bound
        want = np.arange(25)
        while True:
            step = np.where(near, want[None, :], 99).min(axis=1)
            if (step == want).all():
                break
            want = step
        assert ngram_join.in_reach(labels).tolist() == want.tolist()


def boilerplate(rnd, n, own, shared):
    """Texts that share a passage of which each has most, and some near copies among them."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(shared)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(own))])) for i in range(n)]
    return rows + [(n + i, rows[i][1] + " and more") for i in range(0, n, 20)]


def test_crowded_nodes_go_on_to_longer_prefixes(spark, monkeypatch):
    """With small crowds and blocks the links of boilerplate texts and of large groups stay those of all pairs."""
    monkeypatch.setattr(ngram_join, "CROWD", 8)
    monkeypatch.setattr(ngram_join, "NODE_BLOCK", 16)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, base = boilerplate(rnd, 200, 40, 90), [word() for _ in range(100)]
    for i in range(60):
        own = list(base)
        own[rnd.randrange(len(own))] = word()
        rows.append((1000 + i, " ".join(own)))
    links, group = brute_links(dict(rows))
    out = {r.doc_id: r for r in ngram_join.join(documents(spark, rows)).collect()}
    assert {k: r.n_links for k, r in out.items()} == links and {k: r.class_id for k, r in out.items()} == group


def test_boilerplate_makes_no_large_cluster(spark):
    """Texts at a similarity of 0.5 meet at many nodes, but estimates keep them out of one another's clusters."""
    rows = boilerplate(random.Random(5), 400, 40, 85)
    labels = ngram_join.labels_of(ngram_join.shingle_sets([t for _, t in rows]))
    keys = ngram_join.prefix_keys(labels, 4)
    assert max(Counter(keys.reshape(-1).tolist()).values()) > 20  # they do meet
    classes = ngram_join.signatures(documents(spark, rows)).selectExpr("doc_id AS node", "labels")
    clusters = components(ngram_join.candidate_edges(classes)).groupBy("label").count().collect()
    assert max(r["count"] for r in clusters) <= 4
    links, group = brute_links(dict(rows))
    assert {r.doc_id: r.n_links for r in ngram_join.join(documents(spark, rows)).collect()} == links


def test_join_of_repeated_ids_is_stable(spark):
    """Two texts under one id keep their own links, in any order of rows."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    a, b = ([word() for _ in range(80)] for _ in range(2))
    near = lambda words: " ".join([*words[:-1], word()])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (None, " ".join(a)), (None, " ".join(a))]
    for own in (rows, rows[::-1]):
        frame = documents(spark, own)
        out = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.join(frame).collect())
        assert out == [("5", "5", 1), ("5", "5", 1), ("6", "5", 1), ("7", "5", 1), ("None", "None", 0), ("None", "None", 0)]
        kept = ngram_join.near_duplicate_stage(spark, frame, "").collect()
        assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", " ".join(a)), ("5", " ".join(b)), ("None", " ".join(a)), ("None", " ".join(a))])


def test_near_duplicate_stage_keeps_clashing_columns(spark):
    """Columns called as its own, and columns that cannot be ordered, come through; of repeated rows the least stays."""
    text = "the same words again and again in this text"
    rows = [(i % 40, text if i % 2 else f"{text} {i % 40} of many more words that are its own {i % 40}", i, {"k": i}, (i, {"m": i}), [1.0]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hash int, row map<string,int>, `order` struct<a:int,b:map<string,int>>, id array<double>")
    out = ngram_join.near_duplicate_stage(spark, frame, "").collect()
    assert out[0].__fields__ == frame.columns
    _, group = brute_links({r[0]: r[1] for r in rows})
    assert sorted((r.doc_id, r.hash, r.row["k"]) for r in out) == sorted((k, k, k) for k, g in group.items() if k == g)
    assert ngram_join.near_duplicate_stage(spark, frame.filter("false"), "").count() == 0


def test_recall_on_the_larger_scale(spark):
    """Ten times the rows of the SQL check: links are those of all pairs that share a shingle."""
    folder = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    links, group = brute_links(texts)
    out = {r.doc_id: r for r in ngram_join.op3_ngram_join(spark, folder).collect()}
    found = sum(r.n_links for r in out.values())
    assert sum(links.values()) >= found >= 0.999 * sum(links.values())
    assert sum(out[k].class_id != g for k, g in group.items()) <= 0.001 * len(group)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(25)] + [(200, x) for x in range(201, 260)]
    group = {x: x for e in edges for x in e}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        group[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in linked}


# --- 7 urls --------------------------------------------------------------------------------------------------------


def brute_host_path_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best


def test_url_query_is_brute_force(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    rows = url_filter.op7_url_filter(spark, LARGER).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = brute_host_path_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == (("block" if rule.block else "allow") if rule else "block" if r.purity >= url_filter.PURITY else "allow")


def test_url_templates_generalise_and_reject(spark):
    """Where a host's labelled pages of one template are bad, its unlabelled ones of that template go too."""
    rules = [url_filter.Rule("h.test", "/shop/1", True), url_filter.Rule("h.test", "/news/", False)]
    rows = [(i, f"http://h.test/shop/{i}") for i in range(100, 400)] + [(i, f"http://h.test/news/{i}") for i in range(1000, 1100)] + [(i, f"http://h.test/user/n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/home") for i in range(2000, 2400)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(out[i].rule for i in range(100, 200)) and out[250].rule is None
    assert all(out[i].verdict == "block" for i in range(100, 400)) and all(out[i].verdict == "allow" for i in range(1000, 1100))
    assert len({out[i].template for i in range(2000, 2400)}) <= 3 and all(out[i].verdict == "allow" for i in range(2000, 2400))


def test_url_small_blocked_section_stays_apart(spark):
    """Of 40 sections of a host one small one is blocked by rule: the others do not share its template."""
    names = [f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(39)]
    rows = [(100 * k + i, f"http://a.example.com/{name}/{i}") for k, name in enumerate(names) for i in range(12)]
    rows += [(9000 + i, f"http://a.example.com/de/{i}") for i in range(3)] + [(9100 + i, f"http://a.example.com/{name}/x{i}y/home") for i, name in enumerate(["ua", "ub", "uc"] * 4)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(out) == len(rows) and all(out[9000 + i].verdict == "block" and out[9000 + i].purity >= url_filter.PURITY for i in range(3))
    assert all(r.verdict == "allow" and r.purity < url_filter.PURITY for k, r in out.items() if r.rule is None)
    sections = {out[100 * k].template for k in range(39)}
    assert len(sections) == 1 and out[9000].template not in sections and out[9100].template not in sections  # alike or not


def test_url_method_blocks_what_shares_a_template_with_blocked_pages(spark):
    """Unruled pages go where most labelled pages of their template are blocked, and stay where they are not."""
    rules = [url_filter.Rule("w.test", f"/spam-{c}/1", True) for c in "abcdefgh"] + [url_filter.Rule("w.test", f"/blog-{c}/1", False) for c in "abcdefgh"]
    rows = [(1000 * k + i, f"http://w.test/{kind}-{c}/{i}{end}") for k, (kind, c) in enumerate((kind, c) for kind in ("spam", "blog") for c in "abcdefgh") for end in ["/buy" if kind == "spam" else ""] for i in range(100, 300)]
    rows += [(50_000 + i, f"http://w.test/about/{'abcdefgh'[i % 8]}/page") for i in range(300)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    unruled = {i: r for i, r in out.items() if r.rule is None}
    assert len(unruled) == 1900
    assert all(r.verdict == ("block" if i < 8000 else "allow") for i, r in unruled.items())
    assert len({out[1000 * k + 200].template for k in range(8)}) == 1 and not {out[1000 * k + 200].template for k in range(8)} & {out[1000 * k + 200].template for k in range(8, 16)}


def test_url_purity_is_that_of_the_template(spark):
    """Smoothed shares of block labels, counted page by page over what shares a template; deep paths are not lumped."""
    rows = spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "url").collect()
    deep = "/".join("abcdefg")
    more = [(10**6 + i, f"http://d.example.com/{deep}/{'de' if i % 2 else 'en'}/end{'' if i % 2 else i}") for i in range(60)]
    frame = spark.createDataFrame([tuple(r) for r in rows] + more, "page_id long, url string")
    rules = [*url_filter.RULES, url_filter.Rule("d.example.com", f"/{deep}/de/", True)]
    out = url_filter.judge(frame, rules).collect()
    labels = defaultdict(list)
    for r in out:
        labels[r.host, r.template].append(None if r.rule is None else r.verdict)
    for r in out:
        known = [x for x in labels[r.host, r.template] if x]
        assert abs(r.purity - (known.count("block") + url_filter.WEIGHT * url_filter.PRIOR) / (len(known) + url_filter.WEIGHT)) < 1e-9
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in out if r.page_id >= 10**6)


def test_url_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://EXAMPLE.net"), (5, "http://net/"), (6, "https://x.Example.COM/de/1#a"), (7, "http://a.org/fr/"), (7, "http://a.org/fr/"), (8, "http://badnet/"), (9, "http://example.net/en/" + "x/" * 5000), (None, "a://b?c://d")]
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "t", 1.0) for i, u in rows], "page_id long, url string, host string, path string, rule string, template string, purity double")
    out = url_filter.judge(pages).collect()
    assert len(out) == len(rows)
    want = {str(i): brute_host_path_rule(u) for i, u in rows}
    assert all((r.host, r.path, r.rule) == (want[str(r.page_id)][0], want[str(r.page_id)][1], want[str(r.page_id)][2] and want[str(r.page_id)][2].text) for r in out)
    assert all(r.verdict in ("allow", "block") and r.purity is not None for r in out)
    assert url_filter.judge(pages.filter("false")).count() == 0


# --- 9 vectors -----------------------------------------------------------------------------------------------------


def exact(ids, x, step=50, k=5):
    own = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        s = own @ own[q]
        s[ids == ids[q]] = -2
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[: min(k, (s > -2).sum())]]
    return out


@pytest.mark.parametrize("folder", [LARGER, "/root/testdata/sf0.1"])
def test_vector_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth, found = exact(ids, x), defaultdict(list)
    for r in vector_search.op9_vector_search(spark, folder).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    assert set(found) == set(truth)
    assert sum(len({r.vec_id for r in found[q]} & {v for v, _ in t}) for q, t in truth.items()) >= 0.9 * 5 * len(truth)
    where = {int(i): k for k, i in enumerate(ids)}
    for q, own in found.items():
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            a, b = x[where[q]], x[where[r.vec_id]]
            assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


@pytest.mark.parametrize(("centres", "noise"), [(200, 0.3), (2000, 0.5)])
def test_vector_recall_outside_the_sample(spark, monkeypatch, tmp_path, centres, noise):
    """Ten times SAMPLE and more than eight parts: nearly all rows are routed without having been fitted."""
    import pandas as pd

    routers, fit = [], vector_search.fit
    monkeypatch.setattr(vector_search, "fit", lambda *a, **b: routers.append(fit(*a, **b)) or routers[-1])
    rng = np.random.default_rng(6)
    n = 10 * vector_search.SAMPLE
    x = rng.normal(size=(centres, 16))[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, 16))
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "vectors.parquet")
    truth, found = exact(np.arange(n), x), defaultdict(set)
    for r in vector_search.search(spark.read.parquet(f"file://{tmp_path}/vectors.parquet")).collect():
        found[r.query_id].add(r.vec_id)
    assert routers[0].parts > 8 and routers[0].visits < routers[0].parts
    assert sum(len(found[q] & {v for v, _ in t}) for q, t in truth.items()) >= vector_search.TARGET_RECALL * 5 * len(truth)


def test_vectors_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (50, [float("inf"), 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, part int, vector int")
    out = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in vector_search.search(frame).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 100, 0.707107), (0, 4, 3, 0.0), (100, 1, 0, 0.707107), (100, 2, 1, 0.707107), (100, 3, 2, 0.707107), (100, 4, 3, 0.707107)]
    assert vector_search.search(frame.filter("false")).count() == 0 and vector_search.search(frame.filter("vec_id = 0")).count() == 0


def test_vectors_of_any_magnitude_and_length(spark):
    """Tiny and huge vectors, mixed lengths, and repeated ids with different vectors in any order of rows."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 6))
    size = [1e-200, 1e200, 1.0, 1e-308, 1e150][::1]
    rows = [(i, (x * size[i % 5]).tolist()) for i, x in enumerate(base)] + [(100 + i, [1.0, float(i)]) for i in range(4)] + [(200, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0]), (201, [1.0, 0.1, 0.0])]
    outs = []
    for own in (rows, rows[::-1]):
        outs.append([tuple(r) for r in vector_search.search(spark.createDataFrame(own, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()])
    assert outs[0] == outs[1]
    truth = exact(np.arange(60), base)
    found = defaultdict(list)
    for q, _, v, score in outs[0]:
        found[q].append((v, score))
    assert set(found) == {0, 50, 100, 200}
    for q, own in truth.items():
        assert [v for v, _ in own] == [v for v, _ in found[q]] and np.allclose([s for _, s in own], [s for _, s in found[q]], atol=1e-9)
    assert [v for v, _ in found[100]] == [101, 102, 103] and found[200] == [(201, pytest.approx(0.1 / np.sqrt(1.01)))]


def test_hot_vector(spark):
    """A third of the rows are one vector: ties go to the smallest ids, whatever block they are in."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) if i % 3 == 0 else rng.normal(size=8)).tolist()) for i in range(9000)]
    out = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        by[r.query_id].append(r.vec_id)
    hot = [i for i in range(0, 9000, 150)]
    assert all(by[q] == [i for i in range(0, 19, 3) if i != q][:5] for q in hot)


def test_partition_is_balanced_and_routed():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    x = vector_search.unit(np.concatenate([c + 0.1 * rng.normal(size=(100, 16)) for c in centres]))
    graph = vector_search.neighbour_graph(x, 10)
    part = vector_search.balanced_parts(x, graph, 8, rng)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= 107 and sizes.min() >= 60
    router = vector_search.fit(x[rng.permutation(800)], 8)
    assert router.visits <= 3  # clustered vectors need few parts


# --- 10 licenses -----------------------------------------------------------------------------------------------------


def brute_base(text):
    words = [w.decode() for w in text_words(text or "")]
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        own = phrase.split()
        at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = license_scan.op10_license_scan(spark, LARGER).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_a_notice_of_another_version_has_no_label(spark):
    """Words may be missing, but not those that tell a notice from others."""
    first = next(iter(license_scan.NOTICES))
    rows = [(1, first), (2, first.replace("2 0", "3 0")), (3, first.replace("apache", "moon")), (4, first.replace("licensed ", "")), (5, "licensed under cc by nc 3 0 here"), (6, "licensed under cc by nc 4 0 here")]
    out = {r.doc_id: r.labels for r in license_scan.scan(documents(spark, rows))[1].collect()}
    assert {k: "apache-2.0" in v for k, v in out.items() if k < 5} == {1: True, 2: False, 3: False, 4: True}
    assert out[5] == "cc-by" and out[6] == "cc-by,cc-by-nc-4.0"
    assert license_scan.telling("licensed under the mit license version 2", "mit") == 0b1001000


def test_license_spans_with_inserted_words(spark):
    notice = next(iter(license_scan.NOTICES)).split()
    changed = " ".join([*notice[:5], "noted", *notice[5:]])
    rows = [(1, "x y " + " ".join(notice) + " z"), (2, "so " + changed), (3, "licensed under the moon"), (4, "All rights RESERVED; all rights-reserved, cc by cc by general public licenses"), (5, None), (6, ""), (7, "CC by " * 20_000), (4, "All rights RESERVED; all rights-reserved, cc by cc by general public licenses"), (4, "other text of the same id"), (None, "cc by")]
    out = license_scan.scan(documents(spark, rows))
    found = defaultdict(list)
    for r in out[1].collect():
        found[r.doc_id].append(r)
    assert sum(map(len, found.values())) == len(rows)
    assert "apache-2.0" in found[1][0].labels and "apache-2.0" in found[2][0].labels and found[2][0].score == 1.0 and found[3][0].labels == ""
    assert (found[4][0].n_base, len(found[4])) in ((4, 3), (0, 3)) and sorted(r.n_base for r in found[4]) == [0, 4, 4]
    assert found[5][0].n_words == found[6][0].n_words == 0 and found[7][0].n_base == 20_000 and found[7][0].last_word == 39_998 and found[None][0].n_base == 1
    spans = {(r.doc_id, r["first"]) for r in out[0].filter("label = 'apache-2.0'").collect()}
    assert (1, 2) in spans and (2, 1) in spans
    assert license_scan.scan(documents(spark, []))[1].count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_is_its_stages(spark, tmp_path):
    import corpus_pipeline
    from test_text_operators import check_packed
    from tokenizers import Tokenizer

    import public_tokenizers as P

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    texts, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, LARGER)
        assert out.columns == docs.columns
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["near_duplicates"] <= kept["language_id"] <= kept["toxicity"] <= set(texts) and len(kept["language_id"]) >= 0.99 * len(kept["toxicity"])
    _, group = brute_links({k: texts[k] for k in kept["language_id"]})
    assert kept["near_duplicates"] == {k for k, g in group.items() if k == g}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    clean = {k for k, y in labels.items() if not y}
    assert len(clean & kept["toxicity"]) >= 0.9 * len(clean)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {k: tokenizer.encode(texts[k], add_special_tokens=False).ids + [2] for k in kept["near_duplicates"]}
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, LARGER).collect(), ids)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.select("doc_id").distinct().count() <= 200 and corpus_pipeline.ORACLE_SQL is None


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 13)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)} and "pipeline" in names


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in root.glob("tessera/**/*.py"):
        if "llm" not in path.parts:
            assert "tessera.llm" not in path.read_text(), path


def test_hot_rows_split(spark):
    own = documents(spark, [(i, "the very same words in each of these texts") for i in range(3000)])
    out = ngram_join.join(own)
    assert out.agg(F.min("class_id"), F.max("class_id"), F.min("n_links"), F.max("n_links")).first() == (0, 0, 2999, 2999)
