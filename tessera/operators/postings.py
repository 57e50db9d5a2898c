"""Stored postings: an inverted index written once, kept up by segments, and read by the buckets of a query's words.

    postings/segment=/bucket=   (term, range, n, most, shortest, ids, tfs, dls): the documents of one range that hold a term
    documents/segment=          (id, dl)
    dead/segment=               (id, dead_in): documents of earlier segments that a segment replaces
    figures/segment=            documents and words of a segment, and of what it replaces; written last, so it commits the segment

Documents of about the same length share a range of some thousands, so a block's largest score (``most`` occurrences in
the ``shortest`` text) is close to its real ones. A top-k search adds these bounds up range by range from the small columns, scores the
best ranges, and then reads only ranges that may still hold one of the k best; what it skips can't. A hot word has a block a range.
A build deals counted documents once, by their ranges: all blocks of a range are made, and written to their buckets, where its documents are. Scores are those of :mod:`tessera.operators.bm25`.
"""

from __future__ import annotations

import functools
import math
import operator
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.bm25 import K1, B, batch_top, idf, nearest_terms
from tessera.session import spread
from tessera.sources.scratch import stored
from tessera.sources.tables import replace_partitions, table

BUCKETS, RANGE_DOCS = 32, 4096
#: Words of a range at most, about; words from which on a task of the build takes its share, while there are cores for more.
RANGE_WORDS, TASK_WORDS = 4_000_000, 500_000
#: Ranges that a top-k search scores to find its threshold, and questions that are scored together against a range.
SEEDS, QUESTIONS = 8, 256
#: Ranges from which on a top-k search first looks for what it may skip: that takes two small jobs, reading few ranges whole less.
MANY_RANGES = 64


def _schemas(key: str) -> dict[str, str]:
    return {
        "postings": f"term string, range long, n int, most int, shortest int, ids array<{key}>, tfs array<int>, dls array<int>, segment long, bucket int",
        "documents": f"id {key}, dl int, segment long",
        "dead": f"id {key}, dead_in long, segment long",
        "figures": "n long, words long, ranges long, dead_n long, dead_words long, segment long",
    }


@dataclass(frozen=True)
class Index:
    """An index as it stood when it was opened: its tables, and the figures of all its segments together."""

    spark: SparkSession
    path: str
    key: str
    segments: tuple[int, ...]
    n: int
    words: int
    ranges: int
    any_dead: bool

    @property
    def avgdl(self) -> float:
        return self.words / self.n if self.n else 0.0

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(_schemas(self.key)[name]).parquet(f"{self.path}/{name}")
        return rows.filter(F.col("segment").isin(*self.segments))


def opened(spark: SparkSession, path: str, key: str) -> Index:
    """The index under ``path`` with keys of type ``key``; only committed segments count. One row a segment is collected."""
    rows = table(spark, f"{path}/figures", _schemas(key)["figures"]).collect()
    total = lambda c: sum(r[c] for r in rows)
    return Index(spark, path, key, tuple(sorted(r["segment"] for r in rows)), total("n") - total("dead_n"), total("words") - total("dead_words"), total("ranges"), total("dead_n") > 0)


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, dl, terms, tfs) of each text: its words are made by the engine's own expression and counted a batch at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                lists = rows.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                coded = lists.flatten().dictionary_encode()
                wide = max(len(coded.dictionary), 1)
                pairs, tfs = np.unique(np.repeat(np.arange(len(rows)), sizes) * wide + coded.indices.to_numpy(), return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(len(rows) + 1) * wide).astype(np.int32))
                terms = coded.dictionary.take(pa.array(pairs % wide)) if len(pairs) else pa.array([], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32)))], ["id", "dl", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    words = spread(docs.select(key, text)).select(F.col(key).alias("id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("words"))
    return words.mapInArrow(run, f"id {kind}, dl int, terms array<string>, tfs array<int>")


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def _blocks_of_range(docs: pa.Table) -> pa.Table:
    """The blocks of the counted documents (id, dl, terms, tfs, range) of one range, which RANGE_DOCS and RANGE_WORDS bound."""
    docs = docs.sort_by("id")
    lists = docs.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    codes, wide = coded.indices.to_numpy(), len(coded.dictionary)
    order = np.argsort(codes, kind="stable")  # by term, then id
    of = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))[order]
    tf, dl = docs.column("tfs").combine_chunks().flatten().to_numpy()[order], docs.column("dl").to_numpy()[of]
    n = np.bincount(codes, minlength=wide)
    ends = np.cumsum([0, *n])
    most, shortest = (np.maximum.reduceat(tf, ends[:-1]), np.minimum.reduceat(dl, ends[:-1])) if wide else (tf, dl)
    offsets = pa.array(ends, pa.int32())
    held = [pa.ListArray.from_arrays(offsets, x) for x in (docs.column("id").combine_chunks().take(pa.array(of)), pa.array(tf, pa.int32()), pa.array(dl, pa.int32()))]
    small = [pa.array(x, pa.int32()) for x in (n, most, shortest)]
    return pa.table([coded.dictionary, pa.repeat(docs.column("range")[0], wide), *small, *held], names=["term", "range", "n", "most", "shortest", "ids", "tfs", "dls"])


def _once(rows: DataFrame) -> DataFrame:
    """Stored rows with each id once; where none is repeated, which the ids alone tell, nothing is moved."""
    repeated = stored(rows.groupBy(F.col("id").alias("__id")).count().filter("count > 1").select("__id"), "repeated")
    if repeated.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("__id"))
    return stored(rows.join(repeated, same, "left_anti").unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["id"])), "once")


def _write(rows: DataFrame, path: str, key: str, segment: int) -> None:
    """A segment of counted documents (id, dl, terms, tfs); the figures come last."""
    spark = rows.sparkSession
    rows = _once(stored(rows.withColumn("class", F.floor(F.log2(F.col("dl") + 1) * 2)), "counted"))
    sizes = {r["class"]: (r["n"], r["words"]) for r in rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).collect()}  # a class for each half power of two
    parts = {k: max(-(-n // RANGE_DOCS), -(-words // RANGE_WORDS)) for k, (n, words) in sizes.items()}
    total = sum(words for _, words in sizes.values())
    tasks = max(1, min(sum(parts.values()), max(-(-total // RANGE_WORDS), min(-(-total // TASK_WORDS), 2 * spark.sparkContext.defaultParallelism))))
    own = F.col("class")
    among = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), own) if parts else F.lit(1)
    ranged = rows.withColumn("range", own * (1 << 32) + F.pmod(F.xxhash64("id"), among)).repartition(tasks, "range")
    own = ranged.select("id", "dl", "terms", "tfs", "range").groupBy("range").applyInArrow(_blocks_of_range, f"term string, range long, n int, most int, shortest int, ids array<{key}>, tfs array<int>, dls array<int>")
    blocks = own.withColumns({"segment": F.lit(segment).cast("long"), "bucket": _bucket(F.col("term"))})
    before = opened(spark, path, key)
    before = replace(before, segments=tuple(s for s in before.segments if s < segment))  # a repeated segment does not see itself
    live = alive(before, before.table("documents")).select("id", "dl", F.col("segment").alias("dead_in"))
    dead = stored(live.join(rows.select("id"), "id", "left_semi"), "dead")
    mark = F.lit(segment).cast("long").alias("segment")
    replace_partitions(blocks.sortWithinPartitions("segment", "bucket", "term", "range"), f"{path}/postings", "segment", "bucket")
    replace_partitions(rows.select("id", "dl", mark), f"{path}/documents", "segment")
    replace_partitions(dead.select("id", "dead_in", mark), f"{path}/dead", "segment")
    gone = dead.agg(F.count("*").alias("dead_n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dead_words"))
    figures = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).crossJoin(F.broadcast(gone))  # one row each
    replace_partitions(figures.select("n", "words", F.lit(sum(parts.values())).cast("long").alias("ranges"), "dead_n", "dead_words", mark), f"{path}/figures", "segment")


def append(docs: DataFrame, path: str, segment: int, key: str = "doc_id", text: str = "text") -> Index:
    """Add documents as a segment; a document that is there already is replaced. A repeated segment overwrites itself.

    Repeated keys within ``docs`` count once (any of them); segments must come in the order of their numbers.
    """
    kind = docs.schema[key].dataType.simpleString()
    for name, schema in _schemas(kind).items():
        table(docs.sparkSession, f"{path}/{name}", schema)
    _write(counted(docs, key, text), path, kind, segment)
    return opened(docs.sparkSession, path, kind)


def compacted(index: Index, path: str) -> Index:
    """All live documents as one segment of a new index, made from the postings; no text is read."""
    entries = _entries(index, index.table("postings"))
    held = entries.groupBy("id", "dl").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))  # the words of one document
    bare = alive(index, index.table("documents")).filter("dl = 0").select("id", "dl", F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("tfs"))
    for name, schema in _schemas(index.key).items():
        table(index.spark, f"{path}/{name}", schema)
    _write(held.unionByName(bare), path, index.key, 0)
    return opened(index.spark, path, index.key)


def alive(index: Index, rows: DataFrame) -> DataFrame:
    """Rows (id, segment, ...) without documents that a later segment replaced."""
    if not index.any_dead:
        return rows
    return rows.join(index.table("dead").select("id", F.col("dead_in").alias("segment")), ["id", "segment"], "left_anti")


def _entries(index: Index, blocks: DataFrame) -> DataFrame:
    """(term, segment, range, id, tf, dl) of the live documents in blocks."""
    entry = F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
    return alive(index, blocks.select("term", "segment", "range", F.inline(entry)))


def blocks(index: Index, terms: Iterable[str]) -> DataFrame:
    """The blocks of some terms: the scan reads their buckets only, and of these the files and row groups that may hold them."""
    terms = sorted(set(terms))
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    return index.table("postings").filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)) if terms else index.table("postings").filter("false")


def frequencies(index: Index, own: DataFrame) -> DataFrame:
    """(term, df) of the terms of blocks; from their sizes alone while no document was replaced."""
    if index.any_dead:
        return _entries(index, own).groupBy("term").agg(F.count("*").alias("df"))
    return own.groupBy("term").agg(F.sum("n").alias("df"))


def corpus_figures(index: Index, query_terms: list[str]) -> DataFrame:
    """(term, df, n, avgdl) of the terms that occur."""
    return frequencies(index, blocks(index, query_terms)).withColumns({"n": F.lit(index.n).cast("long"), "avgdl": F.lit(index.avgdl)})


def _weighed(index: Index, query_terms: list[str], own: DataFrame) -> dict[str, float]:
    """Count in the query times rarity, of each term that occurs: one small row a query term is collected."""
    rows = frequencies(index, own).collect()
    return {r["term"]: query_terms.count(r["term"]) * math.log(1 + (index.n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in rows}


def _part(weights: dict[str, float], tf: Column, dl: Column, avgdl: float) -> Column:
    known = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair))
    return F.element_at(known, F.col("term")) * tf / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _summed(index: Index, own: DataFrame, weights: dict[str, float]) -> DataFrame:
    part = _part(weights, F.col("tf"), F.col("dl"), index.avgdl)
    return _entries(index, own).groupBy("id").agg(F.sum(part).alias("score"))


def scores(index: Index, query_terms: list[str], key: str = "doc_id") -> DataFrame:
    """(key, score) of the documents that hold a query term; a term named twice counts twice."""
    own = blocks(index, query_terms)
    weights = _weighed(index, query_terms, own)
    if not weights:
        return index.spark.createDataFrame([], f"`{key}` {index.key}, score double")
    return _summed(index, own, weights).withColumnRenamed("id", key)


def bounds(index: Index, own: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(segment, range, bound): what no document of a range can exceed, from the small columns of its blocks."""
    return own.groupBy("segment", "range").agg(F.sum(_part(weights, F.col("most"), F.col("shortest"), index.avgdl)).alias("bound"))


def top(index: Index, query_terms: list[str], k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """(key, score) of the k best by rounded score, then key. Ranges that can't hold one of them are not read."""
    own = blocks(index, query_terms)
    weights = _weighed(index, query_terms, own)
    if not weights:
        return index.spark.createDataFrame([], f"`{key}` {index.key}, score double")
    best = lambda rows: _summed(index, rows, weights).withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "id").limit(k)
    if index.ranges > MANY_RANGES:
        bound = bounds(index, own, weights)
        seeds = bound.orderBy(F.desc("bound"), "segment", "range").limit(SEEDS).collect()
        chosen = functools.reduce(operator.or_, ((F.col("segment") == r["segment"]) & (F.col("range") == r["range"]) for r in seeds))
        found = best(own.filter(chosen)).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if found["n"] == k:
            own = own.join(bound.filter(F.col("bound") >= found["least"] - 10.0**-digits), ["segment", "range"], "left_semi")
    return best(own).withColumnRenamed("id", key)


def vocabulary(index: Index) -> DataFrame:
    """(term, df) of all live documents."""
    return frequencies(index, index.table("postings"))


def expansions(index: Index, query_terms: list[str]) -> DataFrame:
    """(query_term, term, distance): vocabulary of the index near each query term."""
    return nearest_terms(vocabulary(index), query_terms)


def _wanted(questions: DataFrame) -> DataFrame:
    """(question_id, term, weight) of the words of questions."""
    return questions.select("question_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("weight"))


def _asked(index: Index, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of the questions' words, and (question_id, term, weight) weighed by rarity."""
    own = index.table("postings").join(wanted.select("term", _bucket(F.col("term")).alias("bucket")).distinct(), ["term", "bucket"], "left_semi")
    return own, wanted.join(frequencies(index, own), "term").select("question_id", "term", (F.col("weight") * idf(F.lit(index.n), F.col("df"))).alias("weight"))


def batch_scores(index: Index, questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(question_id, key, score) of many questions (question_id, question) in one plan: blocks meet the questions' words, then open."""
    own, weighed = _asked(index, _wanted(questions))
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl)))
    entries = _entries(index, own).select("term", F.col("id").alias(key), share.alias("share"))
    return entries.join(weighed, "term").groupBy("question_id", key).agg(F.sum(F.col("weight") * F.col("share")).alias("score"))


def _best_of_range(blocks: pa.Table, weights: pa.Table, avgdl: float, k: int, slack: float, key: str) -> pa.Table:
    """(question_id, key, score) of documents that may be among a question's k best, from all blocks of some ranges."""
    names = weights.column("question_id").combine_chunks().dictionary_encode()
    of, weight = names.indices.to_numpy(), weights.column("weight").to_numpy()
    by_term: dict[str, list[int]] = {}
    for at, term in enumerate(weights.column("term").to_pylist()):
        by_term.setdefault(term, []).append(at)
    segments, ranges = (blocks.column(c).to_numpy() for c in ("segment", "range"))
    questions, ids, scores = [], [], []
    for segment, part in sorted(set(zip(segments.tolist(), ranges.tolist(), strict=True))) if len(of) else ():
        some = blocks.filter(pa.array((segments == segment) & (ranges == part))).sort_by("term")
        lists = some.column("ids").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        place, ends = coded.indices.to_numpy(), np.cumsum([0, *np.diff(lists.offsets.to_numpy())])
        tf, dl = (some.column(c).combine_chunks().flatten().to_numpy().astype(float) for c in ("tfs", "dls"))
        share = tf / (tf + K1 * (1 - B + B * dl / avgdl))
        score = np.zeros((len(names.dictionary), len(coded.dictionary)))
        for row, term in enumerate(some.column("term").to_pylist()):
            own, at = by_term.get(term, []), slice(ends[row], ends[row + 1])
            score[of[own][:, None], place[at]] += weight[own][:, None] * share[at]
        values = np.array(coded.dictionary.to_pylist(), object)
        for question, own in enumerate(score):
            least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else 0.0
            near = np.flatnonzero((own > 0) & (own >= least - slack))
            near = near[np.lexsort((np.argsort(np.argsort(values[near], kind="stable")), -own[near]))]
            first = np.r_[True, np.diff(own[near]) != 0][: len(near)]
            since = np.arange(len(near)) - np.maximum.accumulate(np.where(first, np.arange(len(near)), 0))
            near = near[since < k]  # of equal scores the k smallest ids
            questions += [question] * len(near)
            ids.append(coded.dictionary.take(pa.array(near)))
            scores.append(own[near])
    found = pa.concat_arrays(ids) if ids else pa.array([], blocks.schema.field("ids").type.value_type)
    return pa.table([names.dictionary.take(pa.array(questions, pa.int64())), found, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["question_id", key, "score"])


def batch_best(index: Index, questions: DataFrame, k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """(question_id, key, score, rank): the k best documents of each of many questions (question_id, question).

    The blocks of a range meet ``QUESTIONS`` questions at a time; only what may be among a question's k best leaves them.
    """
    wanted = _wanted(questions)
    own, weighed = _asked(index, wanted)
    if index.any_dead:
        held = _entries(index, own).groupBy("term", "segment", "range").agg(F.collect_list(F.struct("id", "tf", "dl")).alias("own"))  # a range's documents at most
        own = held.select("term", "segment", "range", F.col("own.id").alias("ids"), F.col("own.tf").alias("tfs"), F.col("own.dl").alias("dls"))
    several = max(1, -(-wanted.select("question_id").distinct().count() // QUESTIONS))
    calls = max(1, index.ranges)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.select("term", "segment", "range", "ids", "tfs", "dls", F.pmod(F.xxhash64("segment", "range"), F.lit(calls)).cast("int").alias("call")).withColumn("some", number(several))
    right = weighed.withColumn("some", F.pmod(F.xxhash64("question_id"), F.lit(several)).cast("int")).withColumn("call", number(calls))
    kind, avgdl = questions.schema["question_id"].dataType.simpleString(), index.avgdl
    run = lambda blocks, weights: _best_of_range(blocks, weights, avgdl, k, 2 * 10.0**-digits, key)
    found = left.groupBy("some", "call").cogroup(right.groupBy("some", "call")).applyInArrow(run, f"question_id {kind}, `{key}` {index.key}, score double")
    return batch_top(found, k, key, digits)
