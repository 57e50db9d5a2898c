import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import chunking as C

TEXTS = st.text(alphabet=st.sampled_from(list("abc .?!\n\té🙂")), max_size=6000)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_sentence_chunks_cover_the_text(text):
    pieces = list(C.sentence_chunks(text))
    assert all(p and p == p.strip() and len(p) <= C.SENTENCE_SIZE for p in pieces)
    at, stripped = 0, text.strip()
    for piece in pieces:  # in order, overlapping by no more than the overlap and skipping white space only
        found = stripped.find(piece, max(0, at - C.SENTENCE_OVERLAP - 2))
        assert found >= 0 and (found <= at or stripped[at:found].strip() == "")
        at = max(at, found + len(piece))
    assert stripped[at:].strip() == ""


def test_sentence_chunk_lengths():
    assert [len(p) for p in C.sentence_chunks("x" * 1501)] == [1500, 201]
    assert [len(p) for p in C.sentence_chunks("x" * 4000)] == [1500, 1500, 1400]
    assert [len(p) for p in C.sentence_chunks("x" * 200)] == [200]
    assert list(C.sentence_chunks("  \n")) == [] == list(C.sentence_chunks(None))
    first = next(C.sentence_chunks("a" * 1000 + "." + "b" * 2000))
    assert first == "a" * 1000 + "."


def test_code_chunks_break_at_lines():
    text = "\n".join("line %d" % i for i in range(1000))
    pieces = list(C.code_chunks(text))
    assert len(pieces) > 1 and all(len(p) <= C.CODE_SIZE for p in pieces)
    assert all(p.startswith("line") or p[0].isdigit() or p[0] in "ine" for p in pieces)


def test_declarations():
    own = "import os\n\n@cached\n@traced(\n    1)\ndef f():\n    return 1\n\nclass A:\n    x = '" + "y" * 250 + "'\n\nif __name__ == '__main__':\n    f()\n"
    head, tail = C.python_chunks(own.replace("import os", "import os  # " + "z" * 200))
    assert head.endswith("z") and tail.startswith("@cached") and tail.endswith("f()") and "\n\nclass A" in tail
    assert list(C.python_chunks("def broken(:")) == ["def broken(:"] == list(C.source_chunks("def broken(:", ".PY"))
    assert list(C.python_chunks("(" * 5000)) and list(C.python_chunks(None)) == []
    java = "package a;\npublic class A {\n int x;\n}\n" + "private void run() {\n" + "y();\n" * 80 + "}\n"
    assert "package" not in "".join(C.java_chunks(java))
    assert list(C.source_chunks("plain", ".txt")) == ["plain"]


LINES = ["import os", "X = 1", "@d", "def f():\n    return '\x0c'", "class A:\n    pass", "async def g(): pass", "f()", "# é " + "c" * 120, "", "if X:\n    f()"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=25), st.sampled_from(["\n", "\r\n", "\n\n"]))
def test_python_chunks_lose_no_line(lines, end):
    text = end.join(lines)
    own = lambda t: [x.strip() for x in t.splitlines() if x.strip()]
    if all(i + 1 < len(lines) and lines[i + 1].startswith(("def", "class", "async", "@")) for i, x in enumerate(lines) if x == "@d") and len(text) <= C.CODE_SIZE:
        assert own("\n".join(C.python_chunks(text))) == own(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True).map(sorted), st.integers(0, 400), st.integers(5, 60), st.integers(0, 1))
def test_windows_end_at_the_last_mark_of_their_second_half(marks, length, size, kept):
    marks = [m for m in marks if m < length]
    overlap = size // 5
    found, last = list(C.spans(np.array(marks, np.int64), length, size, overlap, kept)), None
    assert bool(found) == bool(length) and (not found or found[0][0] == 0 and found[-1][1] == length)
    for first, end in found:
        assert last is None or first == last - overlap
        ends = [m + kept for m in marks if first + size // 2 <= m < first + size]
        assert end == (length if first + size >= length else max(ends, default=first + size))
        last = end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30)), st.integers(1, 60))
def test_small_pieces_merge_until_long_enough(pieces, least):
    groups = [g.split("\n\n") for g in C.merge_small(pieces, least)]
    assert [p for g in groups for p in g] == pieces
    for i, g in enumerate(groups):
        assert len("\n\n".join(g[:-1])) < least and (len("\n\n".join(g)) >= least or i == len(groups) - 1)


def test_parts_and_merging():
    text = "\n\n".join(["p" * 30_000] * 4)
    assert [len(p) for p in C.document_parts(text)] == [60_002, 60_002]
    assert C.document_parts("q" * 100_000) == ["q" * 100_000]
    assert [len(p) for p in C.document_parts("a" * 50_000 + "\n\n" + "b" * 29_996 + "\n\n" + "c" * 90_000 + "\n\nd")] == [79_998, 90_000, 1]
    with pytest.raises(ValueError, match="twice the overlap"):
        list(C.code_chunks("x", 10, 5))
    assert list(C.merge_small(["a" * 150, "b" * 60, "c"])) == ["a" * 150 + "\n\n" + "b" * 60, "c"]


def test_table_function(spark):
    C.register(spark)
    spark.createDataFrame([(1, "x" * 1501), (2, None)], "id int, text string").createOrReplaceTempView("chunk_input")
    rows = spark.sql("SELECT id, c.chunk_index, length(c.chunk_text) AS n FROM chunk_input, LATERAL sentence_chunks(text) c").collect()
    assert sorted((r.id, r.chunk_index, r.n) for r in rows) == [(1, 0, 1500), (1, 1, 201)]
