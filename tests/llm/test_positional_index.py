"""Decontamination against brute force, and the cases of nulls, short items, repeats, long texts and clashing names."""

import re
from hashlib import sha256

import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import positional_index as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text) -> list[str]:
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def windows(text, length=10) -> list[tuple]:
    own = words(text)
    return [tuple(own[i : i + length]) for i in range(max(len(own) - length, 0) + 1)] if own else []


def by_hand(docs, items) -> list[tuple]:
    held: dict[tuple, set] = {}
    for item, text in items:
        for w in windows(text):
            held.setdefault(w, set()).add(str(item))
    out = []
    for doc_id, text in docs:
        own = words(text)
        hit, found = set(), set()
        for w in held:
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= held[w] - {'None'}
        out.append((doc_id, len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    extra = ["1 AS row", "2 AS slice", "'x' AS term", "3 AS slots", "4 AS n", "5 AS id", "'y' AS phrase"]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", *extra),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", *extra),
    )


PASSAGE = "one Two three. four FIVE six, seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "Éa! short item"), (3, None), (4, " ."), (5, "the"), (60, "nine ten eleven twelve " + "x " * 9), (7, "a b a b a b a b a b a b"), (None, "no id here")]
DOCS = [
    (1, None), (2, ""), (3, "..."), (4, PASSAGE), (4, PASSAGE), (None, f"before {PASSAGE} after"), (5, PASSAGE.rsplit(" ", 3)[0]), (6, "the the The"),
    (7, "éa short item Éa short item"), (8, "a b " * 40), (9, "one two three four five six seven eight nine ten x " * 3), (10, "ten eleven twelve x x x x x x x x x x x x x no id here"),
]


def test_hits_are_brute_force(spark):
    assert found(P.contamination(*tables(spark, DOCS, ITEMS))) == by_hand(DOCS, ITEMS)


def test_tables_without_rows(spark):
    assert found(P.contamination(*tables(spark, DOCS, []))) == by_hand(DOCS, [])
    assert found(P.contamination(*tables(spark, [], ITEMS))) == []
    assert found(P.contamination(*tables(spark, [(1, None)], [(1, None)]))) == [(1, 0, 0, [])]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab ", max_size=90), min_size=1, max_size=8), st.lists(st.text("ab ", max_size=40), max_size=4))
def test_few_words_many_overlaps(spark, docs, items):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    assert found(P.contamination(*tables(spark, docs, items))) == by_hand(docs, items)


def test_long_documents_are_cut_with_their_edges(spark, monkeypatch):
    """Slices of a few words: occurrences that cross pieces are found once, with every word they hit."""
    text = " ".join(f"w{i % 97}" for i in range(4000))
    items = [(i, " ".join(f"w{j % 97}" for j in range(i, i + 10 + i % 3))) for i in range(0, 97, 5)]
    spans = [list(P._own_parts(text))]
    monkeypatch.setattr(P, "SLICE", 50)
    monkeypatch.setattr(P, "PIECE", 64)
    spans.append(list(P._own_parts(text)))
    assert [len(s) for s in spans] == [1, len(spans[1])] and len(spans[1]) > 40
    for parts in spans:
        assert [w for held, _, own, upto in parts for w in held[own:upto]] == text.encode().split()
        assert all(number + own == sum(u - o for _, _, o, u in parts[:k]) for k, (_, number, own, _) in enumerate(parts))
    long = (text + " ") * 150  # over the bounds of a piece and of a slice
    docs = [(1, long), (2, text)]
    rows = {r.doc_id: r for r in P.contamination(*tables(spark, docs, items)).collect()}
    assert {k: (r.n_words, len(r.item_ids)) for k, r in rows.items()} == {1: (600_000, len(items)), 2: (4000, len(items))}
    own = words(long)
    held = {w for _, t in items for w in windows(t)}
    hit, until = 0, 0
    for i in range(len(own) - 9):
        if tuple(own[i : i + 10]) in held:
            hit, until = hit + i + 10 - max(i, until), i + 10
    assert rows[1].n_hit == hit


def test_places_and_close_places(spark):
    docs = [(1, "x y alpha beta gamma delta"), (2, "alpha and beta gamma delta"), (3, "beta alpha gamma delta"), (4, "alpha beta and so far gamma delta")]
    args = tables(spark, docs, [(9, "Alpha beta gamma delta")])
    assert [tuple(r) for r in P.matches(*args).collect()] == [(1, "9", "alpha beta gamma delta", 2)]
    assert {r.doc_id for r in P.matches(*args, slop=1).collect()} == {1, 2}
    assert {r.doc_id for r in P.matches(*args, slop=2).collect()} == {1, 2, 3}
    assert {r.doc_id for r in P.matches(*args, slop=3).collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError, match="must not be longer"):
        P.matches(*args, slop=P.REACH)


def test_postings_are_whole(spark):
    docs = [(1, "b a b"), (2, "a"), (3, None)]
    rows = P.index(tables(spark, docs, [])[0]).collect()
    assert sum(r.n for r in rows if r.term is not None) == 4 == sum(r.n for r in rows if r.term is None)
    assert all(len(r.slots) == r.n and list(r.slots) == sorted(r.slots) for r in rows if r.term is not None)
    assert len({r.row for r in rows if r.term is None}) == 3


def test_query_equals_sql(spark, duck):
    from tessera.llm.queries import ORACLE_SQL

    rows = [tuple(r) for r in P.op12_decontamination(spark, DATA).collect()]
    assert sorted(rows) == sorted(duck.execute(ORACLE_SQL["op12_decontamination"]).fetchall()) and any(r[5] for r in rows)
    hand = by_hand(duck.execute("SELECT doc_id, text FROM documents").fetchall(), duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert sorted(rows) == sorted((d, n, h, len(i), sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in hand)
