"""Benchmark decontamination on a positional inverted index of the training texts.

The index is a table of postings: for each slice of the corpus and each word in it, the places ("slots") where the word stands.
Documents lie behind one another in a slice, with gaps wider than any phrase; a very long document is cut into pieces that
repeat ``REACH`` words of their neighbours on both sides. A slice is bounded, and so is each list.

A search takes phrases of words. A phrase is looked up only in slices that hold its rarest words, and there by
intersecting the lists of its words, each shifted by the word's offset, shortest list first. Equal shifted places are exact
occurrences; with a ``slop``, places that differ by so many words at most are close ones. Words are kept
as they are spelled, so an occurrence needs no other check, and no text is read again.

Null and empty texts have no words: such a document has a result without hits, such an item no phrase. Repeated rows of
documents are documents of their own, repeated items are one; an item without an id hits words but is not named. Texts of any length are read in pieces. Extra columns,
whatever their names, are ignored; empty tables are allowed, without items no document is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columnar import bound_batches, documents, stored

LENGTH = 10
#: Words that a piece of a document repeats of its neighbours: the longest phrase with its slop.
REACH = 32
#: Slots of a slice, of which its last piece may take up to twice as many, and bytes of a text that are split at once.
SLICE, PIECE = 1 << 19, 1 << 20
#: Words of a phrase that a slice must hold before the phrase is looked up in it.
RAREST = 3
#: Words of phrases that are broadcast to the postings (some tens of megabytes); more of them meet the postings in a shuffle.
BROADCAST_WORDS = 1 << 20

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def _word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece of it at a time."""
    data, at = (text or "").encode(), 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            stop = _BREAK.search(data, end)
            end = stop.start() if stop else len(data)
        yield data[at:end].translate(_WORDS).split()
        at = end


def _own_parts(text: str | None) -> Iterator[tuple[list[bytes], int, int, int]]:
    """(words, number of the first, from, to): parts of a text whose own words are [from, to), with ``REACH`` words around them."""
    held: list[bytes] = []
    number = own = 0
    for piece in _word_pieces(text):
        held += piece
        if len(held) - own >= SLICE + REACH:
            upto = len(held) - REACH
            yield held, number, own, upto
            keep = max(upto - REACH, 0)
            held, number, own = held[keep:], number + keep, upto - keep
    yield held, number, own, len(held)


_INDEX = ["slice", "term", "slots", "n", "row", "doc_id"]


class _Slice:
    """Words of several documents on the way to postings."""

    def __init__(self, number: int, id_type: pa.DataType) -> None:
        self.number, self.id_type, self.words, self.sizes = number, id_type, [], []
        self.rows: list[tuple[int, object, int, int, int]] = []

    def add(self, row: int, doc_id: object, part: tuple[list[bytes], int, int, int]) -> None:
        words, first, own, upto = part
        self.rows.append((row, doc_id, first, own, upto))
        self.sizes.append(len(words))
        self.words += words

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Postings, one row a word; then a row for each document: its slot, the number of the word there, and the slots of its own words."""
        sizes = np.array(self.sizes, np.int64)
        gaps = REACH * np.arange(len(sizes))
        slots = (np.arange(len(self.words)) + np.repeat(gaps, sizes)).astype(np.int32)
        coded = pa.array(self.words, pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy()
        counts = np.bincount(codes, minlength=len(coded.dictionary))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(slots[np.argsort(codes, kind="stable")]))
        none = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(none, self.number)), coded.dictionary.cast(pa.string()), lists, pa.array(counts.astype(np.int32)), pa.nulls(none, pa.int64()), pa.nulls(none, self.id_type)], _INDEX
        )
        bases = np.cumsum(sizes) - sizes + gaps
        row, ids, first, own, upto = zip(*self.rows, strict=True)
        places = np.stack([bases, first, bases + own, bases + upto], 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), self.number)),
                pa.nulls(len(row), pa.string()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(row) + 1, 4, dtype=np.int32)), pa.array(places.ravel())),
                pa.array((places[:, 3] - places[:, 2]).astype(np.int32)),
                pa.array(row, pa.int64()),
                pa.array(ids, self.id_type),
            ],
            _INDEX,
        )


def index(docs: DataFrame) -> DataFrame:
    """The stored postings (slice, term, slots, n) of ``docs`` (doc_id, text), and for each piece of a document a row without a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        row, number, held = first, first, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for part in _own_parts(text.as_py()):
                    held = held or _Slice(number, batch.column(0).type)
                    held.add(row, doc_id.as_py(), part)
                    if len(held.words) + REACH * len(held.rows) >= SLICE:
                        yield from held.batches()
                        number, held = number + 1, None
                row += 1
        if held:
            yield from held.batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"slice long, term string, slots array<int>, n int, row long, doc_id {kind}"), "postings")


def windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(item_id, phrase): all runs of ``length`` consecutive words of each item; an item of fewer words, but not none, is one phrase."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0), batch.column(1), strict=True):
                last: list[bytes] = []
                short = True
                for piece in _word_pieces(text.as_py()):
                    last += piece
                    found = [b" ".join(last[i : i + length]).decode() for i in range(len(last) - length + 1)]
                    if found:
                        short = False
                        last = last[len(found) :]
                        yield pa.RecordBatch.from_arrays([pa.array([item_id.as_py()] * len(found), pa.string()), pa.array(found)], ["item_id", "phrase"])
                if short and last:
                    yield pa.RecordBatch.from_arrays([pa.array([item_id.as_py()], pa.string()), pa.array([b" ".join(last).decode()])], ["item_id", "phrase"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, phrase string")


def _located(lists: dict[str, np.ndarray], words: list[str], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, slots of the rarest word) of the places where all words stand, each at most ``slop`` from its offset to the rarest one."""
    order = sorted(range(len(words)), key=lambda i: len(lists.get(words[i], ())))
    slots = lists.get(words[order[0]], np.zeros(0, np.int32))
    starts = slots - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        shifted = lists[words[i]] - i
        at = np.searchsorted(shifted, starts - slop)
        stays = shifted[np.minimum(at, len(shifted) - 1)] - starts
        stays = (at < len(shifted)) & (np.abs(stays) <= slop)
        starts, slots = starts[stays], slots[stays]
    return starts, slots


def _search_slice(postings: pa.Table, asked: pa.Table, slop: int, out: pa.Schema) -> pa.Table:
    """Occurrences of the phrases asked of one slice, a row for each document that has any or whose own words are hit."""
    is_term = postings.column("term").is_valid().to_numpy(zero_copy_only=False)
    own = postings.filter(pa.array(is_term)).combine_chunks()
    offsets, values = (own.column("slots").chunk(0).offsets.to_numpy(), own.column("slots").chunk(0).values.to_numpy()) if len(own) else (np.zeros(1, np.int64), np.zeros(0, np.int32))
    lists = {term: values[offsets[k] : offsets[k + 1]] for k, term in enumerate(own.column("term").to_pylist())}
    docs = postings.filter(pa.array(~is_term))
    if not len(docs) or not len(asked):
        return out.empty_table()
    places = np.array(docs.column("slots").to_pylist(), np.int64).reshape(-1, 4)
    order = np.argsort(places[:, 0])
    places = places[order]
    edge = np.zeros(places[:, 3].max() + 2 * REACH + 1, np.int64)  # +1 where an occurrence begins, -1 behind its end
    found_doc, found_phrase, found_start = [], [], []
    for phrase, text in zip(asked.column("id").to_numpy(), asked.column("phrase").to_pylist(), strict=True):
        words = text.split(" ")
        starts, slots = _located(lists, words, slop)
        if not len(starts):
            continue
        of = np.searchsorted(places[:, 0], slots, "right") - 1
        begin = np.maximum(starts, places[of, 0])
        np.add.at(edge, begin, 1)
        np.add.at(edge, starts + len(words), -1)
        mine = (begin >= places[of, 2]) & (begin < places[of, 3])
        found_doc.append(of[mine])
        found_phrase.append(np.full(mine.sum(), phrase))
        found_start.append((begin - places[of, 0] + places[of, 1])[mine])
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    n_hit = covered[places[:, 3]] - covered[places[:, 2]]
    of, phrase, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_doc, found_phrase, found_start))
    by_doc = np.lexsort((phrase, start, of))
    counts = np.bincount(of, minlength=len(places))
    stays = np.flatnonzero((n_hit > 0) | (counts > 0))
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)  # documents that go have no occurrence of their own
    ends = pa.array(np.concatenate([[0], bounds[stays + 1]]).astype(np.int32))
    rows = docs.take(pa.array(order[stays]))
    return pa.table([rows.column("row"), pa.array(n_hit[stays]), pa.ListArray.from_arrays(ends, pa.array(phrase[by_doc])), pa.ListArray.from_arrays(ends, pa.array(start[by_doc]))], schema=out)


def search(postings: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """(row, n_hit, phrases, starts): of each piece of a document its own words that an occurrence of a phrase (id, phrase)
    covers, and the occurrences that begin among them, by phrase and the number of their first word in the document.

    With a ``slop`` the words of a phrase may stand so many places from where the rarest of them puts them, in any order.
    """
    terms = postings.filter("term IS NOT NULL")
    words = phrases.select("id", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    if longest + 2 * slop > REACH:
        raise ValueError(f"a phrase with its slop on both sides must not be longer than {REACH} words")
    vocabulary = stored(words.select("term").distinct(), "vocabulary")
    vocabulary = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_WORDS else vocabulary
    seen = stored(terms.select("term", "slice", "n").join(vocabulary, "term"), "seen")
    frequency = seen.groupBy("term").agg(F.sum("n").alias("n"))
    ranked = words.select("id", "term").distinct().join(frequency, "term", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("own"))
    rare = ranked.filter(~F.exists("own", lambda x: x["n"].isNull())).select("id", F.explode(F.slice("own", 1, RAREST)["term"]).alias("term"), F.least(F.size("own"), F.lit(RAREST)).alias("wanted"))
    held = seen.join(rare, "term").groupBy("slice", "id").agg(F.count("*").alias("held"), F.max("wanted").alias("wanted")).filter("held = wanted")
    asked = stored(held.select("slice", "id"), "asked")
    lists = terms.join(vocabulary, "term").unionByName(postings.filter("term IS NULL"))  # slices that nothing is asked of end in their task
    result = "row long, n_hit long, phrases array<long>, starts array<long>"
    out = pa.schema([("row", pa.int64()), ("n_hit", pa.int64()), ("phrases", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
    pairs = lists.select("slice", "term", "slots", "row").groupBy("slice").cogroup(asked.join(phrases, "id").groupBy("slice"))
    return pairs.applyInArrow(lambda left, right: _search_slice(left, right, slop, out), result)


def numbered(found: DataFrame) -> DataFrame:
    """The distinct phrases with ids, stored."""
    return stored(found.select("phrase").distinct().withColumn("id", F.monotonically_increasing_id()), "phrases")


def matches(docs: DataFrame, items: DataFrame, length: int = LENGTH, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, phrase, start): every place of ``docs`` where a window of an item occurs, or comes close within ``slop``."""
    bound_batches(docs.sparkSession)
    owned = stored(windows(items, length).distinct(), "windows")
    phrases, postings = numbered(owned), index(docs)
    places = search(postings, phrases, slop).select("row", F.inline(F.arrays_zip(F.col("phrases").alias("id"), F.col("starts").alias("start"))))
    rows = postings.filter("term IS NULL").select("row", "doc_id").distinct()
    return places.join(rows, "row").join(phrases, "id").join(owned, "phrase").select("doc_id", "item_id", "phrase", "start")


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) of every row of ``docs``: words inside occurrences of windows of items, and those items, sorted as strings."""
    bound_batches(docs.sparkSession)
    owned = stored(windows(items, length).distinct(), "windows")
    phrases, postings = numbered(owned), index(docs)
    found = stored(search(postings, phrases, slop), "found")
    # A piece speaks of a phrase once, and each document of an item once, before anything is gathered.
    items_of = found.select("row", F.explode(F.array_distinct("phrases")).alias("id")).join(phrases.join(owned, "phrase").select("id", "item_id"), "id").select("row", "item_id").distinct()
    hits = found.select("row", "n_hit", F.lit(None).cast("string").alias("item_id")).unionByName(items_of.select("row", F.lit(0).cast("long").alias("n_hit"), "item_id"))
    hits = hits.groupBy("row").agg(F.sum("n_hit").alias("n_hit"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    rows = postings.filter("term IS NULL").groupBy("row", "doc_id").agg(F.sum("n").alias("n_words"))
    return rows.join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every whole text of ``documents`` stand in windows of ``benchmark`` items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = contamination(documents(spark, sf_dir), items)
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
