"""Spelling variants against all pairs of words, and the cases of nulls, ties, repeats, long runs and clashing names."""

import re
import zlib
from collections import Counter

import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling as S


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_by_hand(rows, least: int = 3) -> dict[str, int]:
    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def variants_by_hand(words: dict[str, int]) -> set[tuple]:
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def found(df) -> list[tuple]:
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_words_of_whole_texts(spark):
    long = "Wörtern " * 30_000 + "x" * 3_000_000 + " ende " + "y" * 2_500_000 + "Ātail tailıtails"
    rows = [(1, None), (2, ""), (3, "Élan élan ÉLAN straße STRAßE 12_abcādefgh"), (4, long), (4, long), (None, "null id word word")] + [(i, "alpha betas Gammas deltas " * 40) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS word", "1 AS n", "'y' AS key", "2 AS near")
    assert {r.word: r.n for r in S.vocabulary(docs, 1).collect()} == words_by_hand(rows, 1)
    assert {r.word: r.n for r in S.vocabulary(docs).collect()} == words_by_hand(rows)


def test_variants_equal_all_pairs(spark):
    words = {"kitten": 40, "kittens": 20, "kittena": 20, "sitten": 9, "sitter": 4, "mitten": 20, "mittens": 3, "aaaaa": 5, "aaaaaa": 5, "aaaaaaa": 10, "aaaab": 5, "élans": 6, "elans": 3, "èlans": 12, "other": 3, "kitetn": 3, "z" * 4000: 4, "z" * 3999 + "y": 8, "z" * 4001: 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = found(S.variants(table))
    assert len(rows) == len(words) and set(rows) == variants_by_hand(words)


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("abcdÿÀ", min_size=5, max_size=8), st.integers(3, 60), min_size=1, max_size=60))
def test_variants_of_crowded_words(spark, words):
    rows = found(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(rows) == len(words) and set(rows) == variants_by_hand(words)


def test_an_edit_leaves_a_band_alone(spark):
    words = ["letters", "lettars", "leters", "aetters", "ÿetters", "lettersÀ"]
    bands = {r.word: [(b.bits, b.letters) for b in r.bands] for r in S.with_bands(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    for w in words[1:]:
        flips = sum(bin(a[0] ^ b[0]).count("1") for a, b in zip(bands["letters"], bands[w], strict=True))
        assert 1 <= flips <= 2
        assert all(a[1] == b[1] for a, b in zip(bands["letters"], bands[w], strict=True) if a[0] == b[0])


def test_forms_lead_to_the_last_root(spark):
    chain = [f"w{i}" for i in range(40)]
    links = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)) + [(f"leaf{i}", "w3") for i in range(50)], "word string, form string")
    assert {r.root for r in S.roots(links).collect()} == {"w39"}
    assert S.roots(links.limit(0)).count() == 0


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Even where Spark takes every table for a small one."""
    plans, store = [], S.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "stored", lambda df, name: (plans.append(plan(df)), store(df, name))[1])
    table = spark.createDataFrame([("kitten", 40), ("kittens", 20), ("kittensx", 3), ("other", 3)], "word string, n long")
    result = S.variants(table)
    plans.append(plan(result))
    assert {r.word: r.root for r in result.collect()} == {"kitten": "kitten", "kittens": "kitten", "kittensx": "kitten", "other": "other"}
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert found(S.variants(S.vocabulary(docs))) == []
    assert found(S.variants(S.vocabulary(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")))) == []


def test_query_equals_sql(spark, duck):
    from tessera.llm.queries import ORACLE_SQL

    rows = found(S.op11_spelling_variants(spark, DATA))
    assert sorted(rows, key=repr) == sorted(duck.execute(ORACLE_SQL["op11_spelling_variants"]).fetchall(), key=repr)
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert {r[0]: r[3] for r in rows} == words_by_hand(texts)


@pytest.mark.parametrize("text", ["x" * 12, "ab cd", "Ünïcödé"])
def test_pieces_keep_every_run(text):
    assert b"".join(S._pieces(text)) == text.encode("latin-1", "replace")
