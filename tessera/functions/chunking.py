"""Splitting texts into chunks. Boundaries depend on the text before them, so these run in Arrow batches, one text at a time."""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.session import spread

SENTENCE_SIZE, SENTENCE_OVERLAP = 1500, 200
CODE_SIZE, CODE_OVERLAP = 2000, 200
DOCUMENT_LIMIT, SMALL = 80_000, 200
WHOLE_DECISION, DECISION_STEP = 12_000, 6_000
# Fixed value: what begins a declaration in Java sources.
JAVA_DECLARATION = re.compile(r"(?:^|\n)(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|@interface)\s+\w+", re.MULTILINE)
_SENTENCE_END, _LINE_END, _NEXT_LINE = re.compile(r"[.?!]"), re.compile(r"\n"), re.compile(r"\r\n?|\n")


def spans(marks: np.ndarray, length: int, size: int, overlap: int, kept: int) -> Iterator[tuple[int, int]]:
    """Windows of at most ``size`` characters over a text of ``length``, each beginning ``overlap`` before the last one's end.

    ``marks`` are the sorted places where a window may end, ``kept`` how many characters at such a place it keeps. A window
    ends at the last mark of its second half; without one, or where the text ends, it is full.
    """
    if size // 2 <= overlap:
        raise ValueError("a window must be longer than twice the overlap")
    first = last = 0
    while last < length:
        full = first + size
        if full >= length:
            last = length
        else:
            low, high = np.searchsorted(marks, (first + size // 2, full))
            last = int(marks[high - 1]) + kept if high > low else full
        yield first, last
        first = last - overlap


def _windows(text: str, mark: re.Pattern[str], size: int, overlap: int, kept: int) -> Iterator[str]:
    marks = np.fromiter((m.start() for m in mark.finditer(text)), np.int64)
    own = (text[first:last].strip() for first, last in spans(marks, len(text), size, overlap, kept))
    return (piece for piece in own if piece)


def sentence_chunks(text: str | None, size: int = SENTENCE_SIZE, overlap: int = SENTENCE_OVERLAP) -> Iterator[str]:
    """Windows that end behind a full stop."""
    return _windows((text or "").strip(), _SENTENCE_END, size, overlap, kept=1)


def code_chunks(text: str | None, size: int = CODE_SIZE, overlap: int = CODE_OVERLAP) -> Iterator[str]:
    """Windows that end at a line's end."""
    return _windows(text or "", _LINE_END, size, overlap, kept=0)


def merge_small(pieces: Sequence[str], least: int = SMALL) -> Iterator[str]:
    """Neighbours joined by a blank line until each has the least length; the last may fall short.

    ``ends`` is where each piece would end if all were joined, so a group ends with the first piece far enough from the group before.
    """
    ends = np.cumsum([len(p) + 2 for p in pieces])
    first, before = 0, 0
    while first < len(pieces):
        last = int(np.searchsorted(ends, before + least + 2)) + 1
        yield "\n\n".join(pieces[first:last])
        first, before = last, int(ends[min(last, len(pieces)) - 1])


def _between(text: str, starts: list[int]) -> Iterator[str]:
    """Small pieces merged: from each start to the next, and to the end."""
    own = (text[a:b].strip() for a, b in itertools.pairwise([*starts, len(text)]))
    return merge_small([piece for piece in own if piece])


def python_chunks(text: str | None) -> Iterator[str]:
    """Cut where a top-level function or class begins, its decorators included; what stands before, between and behind
    them is kept. Sources that do not parse, or have none, are split as text."""
    text = text or ""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return code_chunks(text)
    lines = [0, *(m.end() for m in _NEXT_LINE.finditer(text))]
    found = [min([n.lineno, *(d.lineno for d in n.decorator_list)]) for n in body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    return _between(text, [0, *(lines[line - 1] for line in found)]) if found else code_chunks(text)


def java_chunks(text: str | None) -> Iterator[str]:
    """From each declaration to the next; what stands before the first is left out."""
    text = text or ""
    starts = [m.start() for m in JAVA_DECLARATION.finditer(text)]
    return _between(text, starts) if starts else code_chunks(text)


def source_chunks(text: str | None, extension: str | None) -> Iterator[str]:
    by_kind: dict[str, Callable[[str | None], Iterator[str]]] = {".py": python_chunks, ".java": java_chunks}
    return by_kind.get((extension or "").lower(), code_chunks)(text)


def document_parts(text: str | None, limit: int = DOCUMENT_LIMIT) -> list[str]:
    """Paragraphs gathered up to the limit; a longer paragraph stays whole."""
    text = text or ""
    if len(text) <= limit:
        return [text]
    paragraphs = text.split("\n\n")
    ends = np.cumsum([len(p) + 2 for p in paragraphs])
    parts, first, before = [], 0, 0
    while first < len(paragraphs):
        last = max(int(np.searchsorted(ends, before + limit, "right")), first + 1)
        parts.append("\n\n".join(paragraphs[first:last]))
        first, before = last, int(ends[last - 1])
    return parts


def decision_chunks(text: Column) -> Column:
    """A decision document whole, or in steps without overlap if it is long. Native."""
    text = F.coalesce(text, F.lit(""))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(DECISION_STEP)), lambda i: F.substring(text, i, F.lit(DECISION_STEP)))
    return F.when(F.length(text) < WHOLE_DECISION, F.array(text)).otherwise(steps)


def numbered_title(title: Column, part: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.concat(title, F.lit(" (part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))).otherwise(title)


_SPLITTERS: dict[str, Callable[[str | None, str | None], Iterable[str]]] = {
    "sentence": lambda text, _: sentence_chunks(text),
    "source": source_chunks,
    "parts": lambda text, _: document_parts(text),
}


def chunked(df: DataFrame, splitter: str, text: str = "text", key: str = "doc_id", extension: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(key, chunk_index, chunk_text, *keep) of every row. Text is streamed through in Arrow batches; nothing is shuffled."""
    split = _SPLITTERS[splitter]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                found = [list(split(t, e)) for t, e in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)]
                of = pa.array([k for k, pieces in enumerate(found) for _ in pieces], pa.int64())
                numbers = pa.array([i for pieces in found for i in range(len(pieces))], pa.int32())
                pieces = pa.array([p for pieces in found for p in pieces], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(of), numbers, pieces, *(rows.column(3 + i).take(of) for i in range(len(keep)))], [key, "chunk_index", "chunk_text", *keep])

    own = F.col(extension) if extension else F.lit(None).cast("string")
    schema = StructType([df.schema[key], StructField("chunk_index", IntegerType()), StructField("chunk_text", StringType()), *(df.schema[c] for c in keep)])
    return spread(df.select(key, text, own.alias("__extension"), *keep)).mapInArrow(run, schema)


@udtf(returnType=StructType([StructField("chunk_index", IntegerType()), StructField("chunk_text", StringType())]))
class SentenceChunks:
    """The sentence chunker as a table function, for SQL: SELECT ... FROM t, LATERAL sentence_chunks(t.text)."""

    def eval(self, text: str):
        yield from enumerate(sentence_chunks(text))


def register(spark) -> None:
    spark.udtf.register("sentence_chunks", SentenceChunks)
