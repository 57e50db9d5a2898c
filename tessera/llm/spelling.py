"""Spelling variants: words one edit apart, found on bands of their letter-parity masks, grouped under the commonest form.

A word's mask holds a bit for each letter: whether the letter stands in it an odd number of times. One edit flips at most
two bits, so of three bands of the mask one at least is left alone; words that share no band are never compared. A band
alone is a coarse key (most words of eight letters share some band with a hundredth of the vocabulary), so its
buckets are split by what an edit outside the band leaves alone as well: the band's letters in their order, the length
of the shorter word, and all but one of ``SEGMENTS`` parts of it. The split loses no pair and needs no cap; what still
meets in a bucket is verified by its edit distance. A word has at most a few thousand near words (its length times the
letters), so no group of the result is hot.

Tables of words grow with the texts, and Spark sizes them too low: an explode counts as one row, a stored table as its compressed
file. Their joins are therefore hinted to shuffle both sides (``merge``), so none of them reaches the driver as a broadcast.

Null and empty texts have no words; an id that is null is spelled as an empty one. Texts and single runs of any length
are read in pieces of about ``PIECE`` letters. Repeated rows each count. Extra columns, whatever their names, are ignored;
an empty table has no words and gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columnar import documents, stored

LEAST_LENGTH, LEAST_COUNT, DELETE_ONE_IN = 5, 3, 97
#: Parts of a word, one of which an edit may touch: more make smaller buckets and more rows.
SEGMENTS = 3
#: Letters split at once, and distinct words held before they are handed on.
PIECE, HELD = 1 << 20, 1 << 17
#: Bits of one band: letters of U+0061 to U+011D have a bit of their own, others share one.
BAND_BITS = 63

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 192 else 32 for c in bytes(range(256)).lower())
_BREAK = re.compile(rb"[^A-Za-z\xc0-\xff]")


def _pieces(text: str) -> Iterator[bytes]:
    """One byte a code point (others than the letters become a break), cut between runs."""
    data, at = text.encode("latin-1", "replace"), 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            stop = _BREAK.search(data, end)
            end = stop.start() if stop else len(data)
        yield data[at:end]
        at = end


def _spelled(run: bytes, prefix: int, one_in: int) -> bytes:
    """The run, or, for one in ``one_in`` by the checksum of id and run, the run without one letter."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def occurrences(docs: DataFrame, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` letters with how often a part of the rows holds them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for own_id, text in zip(batch.column(0), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{own_id.as_py() or ''}:".encode())
                for piece in _pieces(text.as_py() or ""):
                    for own, n in Counter(piece.translate(_LETTERS).split()).items():
                        if len(own) >= LEAST_LENGTH and len(word := _spelled(own, prefix, one_in)) >= LEAST_LENGTH:
                            held[word] += n
                    if len(held) >= HELD:
                        yield out()
        yield out()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words that occur at least ``least`` times in all."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _number(letter: Column) -> Column:
    """The letter's bit in the whole mask; the remainder by three is its band."""
    return F.pmod(F.ascii(letter) - 97, F.lit(3 * BAND_BITS))


def with_bands(words: DataFrame) -> DataFrame:
    """Adds ``bands``: the three bands of the parity mask, each with its bits and, in order, the letters that they stand for."""
    letters = F.split("word", "")
    own = lambda k: F.filter(letters, lambda c: _number(c) % 3 == k)
    bits = lambda k: F.aggregate(own(k), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (_number(c) / 3).cast("int"))))
    return words.withColumn("bands", F.array(*(F.struct(F.lit(k).alias("band"), bits(k).alias("bits"), F.array_join(own(k), "").alias("letters")) for k in range(3))))


def _keyed(banded: DataFrame, longer: int) -> DataFrame:
    """A row for each band and each part that the edit may be in, of words as the shorter (0) or the longer (1) of a pair."""
    short = F.length("word") - longer
    cut = lambda i: F.floor(short * i / SEGMENTS).cast("int")
    kept = lambda i: F.struct(F.lit(i).alias("part"), F.left("word", cut(i)).alias("head"), F.right("word", short - cut(i + 1)).alias("tail"))
    parts = banded.withColumn("band", F.explode("bands")).withColumn("kept", F.explode(F.array(*map(kept, range(SEGMENTS)))))
    key = F.xxhash64("band.band", "band.bits", "band.letters", short, "kept.part", "kept.head", "kept.tail")
    return parts.select(key.alias("key"), "word", "n", short.alias("short"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words (word, n) one edit apart, once."""
    banded = with_bands(words)
    first = _keyed(banded, 0)
    second = first.unionByName(_keyed(banded, 1)).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    longer = F.length("near") > F.col("short")
    pairs = first.join(second.hint("merge"), "key").filter((longer | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
    ways = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(ways)).repartition("word").distinct()  # dealt by word: the sums over a word need no shuffle of their own


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form that a word's forms (word, form) lead to.

    Each round doubles the way a word has gone; a form is twice as common as its word, so a few rounds reach the end. The driver sees
    one flag a round.
    """
    links = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word (word, n).

    The form is the commonest near word, the first by code points among equals, if it occurs at least twice as often.
    """
    words = stored(words, "vocabulary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.near"))
    formed = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    formed = stored(formed, "formed")
    led = roots(formed.filter("form IS NOT NULL"))
    return formed.join(led.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all whole texts of ``documents``."""
    return variants(vocabulary(documents(spark, sf_dir))).select("word", "form", "root", "n", "n_near", "form_n")
