"""Edit-aware token counts.

A document is kept as its pre-tokens in a segment tree whose nodes hold the characters and tokens below them. An edit
replaces a range of characters: the tree is descended to the range, pre-tokens are split anew from ``CONTEXT`` pieces
before it up to the first boundary behind it that the old split had too (the pattern never looks back, so all that
follows is unchanged), only pieces in between are counted anew, and the sums above the touched leaves are updated.

A null text is empty, and an edit of it inserts. Ranges are clipped to the text; a null replacement deletes; an edit
without start or stop does nothing; edits of a document apply in the order given, each to the text the one before left.
Very long texts are split into pre-tokens in parts and kept whole as these. Repeated rows give equal results, extra
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import MergeReplay, read_ranks
from tessera.llm.columnar import documents, stored, text_slices
from tessera.llm.word_cache import ENTRY_BYTES, WordCache, segments

#: Pre-tokens in a fresh leaf; a leaf that outgrows four times this makes the tree deal its pieces anew.
LEAF = 64
#: Pieces before an edit that it may split otherwise: a white-space run makes two, a contraction follows its apostrophe.
CONTEXT = 3
#: Characters that a match may look at beyond its end.
AHEAD = 3
#: Bytes of each generation of a worker's word cache.
CACHE_BYTES = 64 << 20
#: Edits of one document that one task applies; a document with more takes several rounds.
EDITS_AT_ONCE = 10_000


class TokenCounter:
    """Token counts of pre-tokens, each distinct one encoded once while the bounded cache holds it."""

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        self.replay = MergeReplay(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.words = WordCache(lambda words: self.replay.count([w.encode() for w in words]), cache_bytes)

    @property
    def cache(self) -> dict[str, int]:
        return self.words.young

    def learn(self, pieces: Iterable[Sequence[str]], may_turn: bool = False) -> None:
        """Make sure that ``cache`` has all pieces; rare ones may go first if no text is open."""
        if may_turn:
            self.words.turn()
        self.words.hold(pieces)

    def total(self, pieces: Sequence[str]) -> int:
        """Tokens of these pieces; those that are not held are counted first."""
        try:
            return sum(map(self.words.young.__getitem__, pieces))
        except KeyError:
            return sum(map(self.words.hold([pieces]).__getitem__, pieces))

    def split(self, text: str) -> list[str]:
        return [p for part in segments(text) for p in self.pattern.findall(part)]


class CountedText:
    """A text's pre-tokens in a segment tree of character and token sums."""

    def __init__(self, pieces: list[str], counter: TokenCounter):
        self.counter = counter
        self.recounted = 0  # characters whose tokens were counted again by edits
        self._deal(pieces)

    @classmethod
    def restored(cls, row: dict, counter: TokenCounter) -> CountedText:
        """The tree that :meth:`kept` wrote: its sums are taken as they are."""
        own = cls.__new__(cls)
        own.counter, own.recounted, own.leaves = counter, 0, []
        at = 0
        for size in row["leaf_sizes"]:
            own.leaves.append(row["pieces"][at : at + size])
            at += size
        own.base, own.chars, own.tokens = len(row["tokens"]) // 2, row["chars"], row["tokens"]
        return own

    def kept(self) -> tuple[list[str], list[int], list[int], list[int], list[int]]:
        """Pieces, their counts, pieces of each leaf, and the sums of characters and tokens of every node."""
        pieces = [p for leaf in self.leaves for p in leaf]
        return pieces, list(map(self.counter.cache.__getitem__, pieces)), list(map(len, self.leaves)), self.chars, self.tokens

    def _deal(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        of = self.counter.total
        for k, leaf in enumerate(self.leaves):
            self.chars[self.base + k], self.tokens[self.base + k] = len("".join(leaf)), of(leaf)
        for node in range(self.base - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _refresh(self, leaf: int) -> None:
        node = self.base + leaf
        chars = len("".join(self.leaves[leaf])) - self.chars[node]
        tokens = self.counter.total(self.leaves[leaf]) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node >>= 1

    def _locate(self, at: int) -> tuple[int, int, int]:
        """Leaf, piece in it, and start of the piece that holds character ``at`` (the last piece beyond the end)."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        leaf, piece = node - self.base, 0
        for piece, text in enumerate(self.leaves[leaf]):
            if at - start < len(text) or piece == len(self.leaves[leaf]) - 1:
                break
            start += len(text)
        return leaf, piece, start

    def _back(self, leaf: int, piece: int, start: int) -> tuple[int, int, int]:
        for _ in range(CONTEXT):
            other = leaf
            while not piece:
                other -= 1
                if other < 0:
                    return leaf, 0, start
                piece = len(self.leaves[other])
            leaf, piece = other, piece - 1
            start -= len(self.leaves[leaf][piece])
        return leaf, piece, start

    def edit(self, start: int, stop: int, replacement: str) -> None:
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        leaf, piece, begin = self._back(*self._locate(max(start - 1, 0)))
        first = leaf
        head = self.leaves[leaf][:piece]
        window, wanted = 0, 16
        old: list[str] = []  # pieces from ``begin`` on, as far as they were looked at
        ends: list[tuple[int, int]] = []  # leaf and piece of each
        at_leaf, at_piece, old_size = leaf, piece, 0
        while True:
            while at_leaf < len(self.leaves) and (begin + old_size < stop or window < wanted):
                if at_piece >= len(self.leaves[at_leaf]):
                    at_leaf, at_piece = at_leaf + 1, 0
                    continue
                text = self.leaves[at_leaf][at_piece]
                window += begin + old_size >= stop
                old.append(text)
                ends.append((at_leaf, at_piece))
                old_size += len(text)
                at_piece += 1
            complete = begin + old_size == self.n_chars and not any(self.leaves[at_leaf][at_piece:] if k == at_leaf else self.leaves[k] for k in range(at_leaf, min(at_leaf + 2, len(self.leaves))))
            joined = "".join(old)
            fresh = joined[: start - begin] + replacement + joined[stop - begin :]
            shift = len(replacement) - (stop - start)
            boundaries, place = {}, 0
            for k, text in enumerate(old):
                place += len(text)
                boundaries[place + shift] = k
            new, synced = [], None
            for match in self.counter.pattern.finditer(fresh):
                end = match.end()
                new.append(match.group())
                if end >= start - begin + len(replacement) and end in boundaries and end <= len(fresh) - AHEAD:
                    synced = boundaries[end]
                    break
            if synced is not None or complete:
                break
            wanted *= 4
        if synced is None:
            synced = len(old) - 1
        self.recounted += sum(map(len, new))
        last_leaf, last_piece = ends[synced] if old else (first, -1)
        tail = self.leaves[last_leaf][last_piece + 1 :]
        for k in range(first, last_leaf + 1):
            self.leaves[k] = []
        if first == last_leaf:
            self.leaves[first] = head + new + tail
        else:
            self.leaves[first], self.leaves[last_leaf] = head + new, tail
        if max(len(self.leaves[first]), len(self.leaves[last_leaf])) > 4 * LEAF:
            self._deal([p for own in self.leaves for p in own])
            return
        for k in range(first, last_leaf + 1):
            self._refresh(k)


_counters: dict[tuple[str, str], TokenCounter] = {}


def counter(path: str, pattern: str) -> TokenCounter:
    """The worker's counter for a vocabulary; built once in each Python process."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = TokenCounter(path, pattern)
    return _counters[path, pattern]


def count_edited(docs: DataFrame, edits: Column, path: str, pattern: str) -> DataFrame:
    """Counts of every text before and after its edits: an array of (start, stop, replacement), in order, on each row.

    Edits that come as a table are first gathered into such an array by document and joined.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            for rows, texts in text_slices(batch):
                split = [own.split(t) for t in texts]
                own.learn(split, may_turn=True)
                out = []
                for pieces, todo in zip(split, rows.column(2).to_pylist(), strict=True):
                    tree = CountedText(pieces, own)
                    before = tree.n_tokens
                    for edit in todo or ():
                        if edit is not None and edit["start"] is not None and edit["stop"] is not None:
                            tree.edit(edit["start"], edit["stop"], edit["replacement"] or "")
                    out.append((before, len(todo or ()), tree.n_tokens, tree.n_chars, tree.recounted))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], ["doc_id", "tokens_before", "n_edits", "n_tokens", "n_chars", "recounted_chars"])

    return docs.select("doc_id", "text", edits.alias("edits")).mapInArrow(run, "doc_id long, tokens_before long, n_edits long, n_tokens long, n_chars long, recounted_chars long")


TREES = "doc_id long, pieces array<string>, counts array<int>, leaf_sizes array<int>, chars array<long>, tokens array<long>"
_KINDS = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
TREE_COLUMNS = ["doc_id", "pieces", "counts", "leaf_sizes", "chars", "tokens"]


def kept_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every document's tree, its leaves and the sums of its nodes, to be stored between rounds of edits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            for rows, texts in text_slices(batch):
                split = [own.split(t) for t in texts]
                own.learn(split, may_turn=True)
                columns = zip(*(CountedText(pieces, own).kept() for pieces in split), strict=True)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, kind) for x, kind in zip(columns, _KINDS, strict=True))], TREE_COLUMNS)

    return docs.select("doc_id", "text").mapInArrow(run, TREES)


def _applied(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Trees with a column of ``edits`` after these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                own.words.turn()
                own.words.young.update(zip(row["pieces"], row["counts"], strict=True))
                own.words.held += sum(map(len, row["pieces"])) + ENTRY_BYTES * len(row["pieces"])  # at most: repeated pieces are one entry
                tree = CountedText.restored(row, own)
                for edit in row["edits"]:
                    if edit["start"] is not None and edit["stop"] is not None:
                        tree.edit(edit["start"], edit["stop"], edit["replacement"] or "")
                columns = [pa.array([x], kind) for x, kind in zip(tree.kept(), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.slice(at, 1).column(0), *columns, pa.array([tree.n_tokens]), pa.array([tree.recounted])], [*TREE_COLUMNS, "n_tokens", "recounted_chars"])

    return rows.select(*TREE_COLUMNS, "edits").mapInArrow(run, f"{TREES}, n_tokens long, recounted_chars long")


def edited_trees(trees: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """The trees after ``edits`` (doc_id, seq, start, stop, replacement), with n_tokens and recounted_chars.

    Only trees that have edits meet Python, and of these only what an edit touches is counted; ties of seq apply in the
    order of start, stop and replacement. An edit without start or stop, or of a document without a tree, does nothing,
    nor does one whose doc_id is null. A document with more than ``EDITS_AT_ONCE`` edits takes several rounds.
    """
    trees = trees.select(*TREE_COLUMNS)
    order = "row_number() OVER (PARTITION BY doc_id ORDER BY seq, start, stop, replacement) - 1"
    known = edits.filter("doc_id IS NOT NULL").select("doc_id", "seq", "start", "stop", "replacement")
    turns = stored(known.withColumn("at", F.expr(order)).withColumn("turn", F.expr(f"cast(floor(at / {EDITS_AT_ONCE}) AS int)")), "edits")
    listed = turns.groupBy("doc_id", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "start", "stop", "replacement"))).alias("edits"))  # EDITS_AT_ONCE at most
    last = turns.agg(F.max("turn")).first()[0] or 0
    joined = trees.join(listed.filter("turn = 0").drop("turn"), "doc_id", "left")
    total = F.coalesce(F.get("tokens", F.lit(1)), F.lit(0))
    untouched = joined.filter("edits IS NULL").select(*TREE_COLUMNS, total.alias("n_tokens"), F.lit(0).cast("long").alias("recounted_chars"))
    done = _applied(joined.filter("edits IS NOT NULL"), path, pattern)
    if last:
        more = turns.groupBy("doc_id").agg(F.max("turn").alias("last"))
        done = stored(done.join(more, "doc_id"), "trees")
        finished = done.filter("last = 0")
        open_ = done.filter("last > 0")
        for turn in range(1, last + 1):
            before = open_.select("doc_id", F.col("recounted_chars").alias("earlier"), "last")
            rows = _applied(open_.join(listed.filter(F.col("turn") == turn).drop("turn"), "doc_id"), path, pattern)
            rows = stored(rows.join(before.dropDuplicates(["doc_id"]), "doc_id").withColumn("recounted_chars", F.expr("recounted_chars + earlier")).drop("earlier"), "trees")
            finished = finished.unionByName(rows.filter(F.col("last") == turn))
            open_ = rows.filter(F.col("last") > turn)
        done = finished.drop("last")
    return untouched.unionByName(done)


def sample_edits(text: Column) -> Column:
    """Five edits that any text takes: words replaced at a third, a break put in at two thirds, the first word cut, text appended, a join."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    third = F.floor(n / 3)
    one = lambda start, stop, replacement: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(replacement).alias("replacement"))
    return F.array(
        one(third, third + 7, " edited words don't"), one(2 * third, 2 * third, "\n\n  "), one(F.lit(0), F.lit(4), ""), one(n + 20, n + 20, " appended."), one(F.floor(n / 2), F.floor(n / 2) + 1, "")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents`` before and after a fixed list of edits."""
    return count_edited(documents(spark, sf_dir), sample_edits(F.col("text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
