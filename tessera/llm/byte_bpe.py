"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a slice of the corpus are encoded together. An inverted index maps every mergeable pair
to the positions where it stands; merges run in rank order over all words at once, and a merge touches only the
neighbours of its positions. Encoded words are kept in a cache bounded in bytes that the Python worker reuses between
slices and tasks, so a frequent word is replayed once for each worker. Where only the number of ids is wanted, many
short words are merged in step: a word's own merges go in rank order, and words do not meet, so each wave makes the next
merge of every word with whole-array operations.

Null texts are encoded as empty. Empty texts give no ids and the digest of no bytes. Very long texts are split into
words in parts, so that only their ids are held whole. Rows are independent: repeated rows give repeated results and
extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.columnar import SLICE_CHARS, documents, text_slices
from tessera.llm.word_cache import WordCache, groups

#: Bytes of each generation of a worker's word cache.
CACHE_BYTES = 64 << 20
#: Words whose ids are counted at once in waves; fewer are replayed one merge after another.
WAVE_WORDS = 200
#: Bytes of the words that are laid side by side, by width; longer ones are replayed. At most 64: see ``_PLACE``.
WIDTHS = (8, 12, 16, 24, 32)
#: Bits of a place in a word beside the rank of its pair, and what stands where no pair merges.
_PLACE, _NONE = 6, np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Applies the merges of a rank table to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        #: left id << 32 | right id, of every mergeable pair, to the id of what they merge to
        self.merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = rank

    @functools.cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs in order, their ranks, and the rank of every two bytes; ``_NONE >> _PLACE`` where they do not merge."""
        pairs = np.fromiter(self.merges.keys(), np.int64, len(self.merges))
        ranks = np.fromiter(self.merges.values(), np.int32, len(self.merges))
        order = np.argsort(pairs)
        pairs, ranks = np.append(pairs[order], np.iinfo(np.int64).max), np.append(ranks[order], np.int32(_NONE >> _PLACE))
        ids = np.array(self.of_byte, np.int64)
        wanted = (ids[:, None] << 32 | ids).ravel()
        at = np.searchsorted(pairs, wanted)
        return pairs, ranks, np.where(pairs[at] == wanted, ranks[at], np.int32(_NONE >> _PLACE))

    def count(self, words: list[bytes]) -> list[int]:
        """Number of ids of each word, as of :meth:`encode`."""
        out = [1 if word in self.ranks else len(word) for word in words]
        todo = [k for k, n in enumerate(out) if n > 1]
        if len(todo) >= WAVE_WORDS:
            sizes = np.array([out[k] for k in todo])
            for narrow, wide in zip((1, *WIDTHS), WIDTHS):
                some = [todo[i] for i in np.flatnonzero((sizes > narrow) & (sizes <= wide)).tolist()]
                for k, n in zip(some, self._waves([words[k] for k in some], wide) if some else ()):
                    out[k] = n
            todo = [todo[i] for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist()]
        for k, ids in zip(todo, self.encode([words[k] for k in todo]), strict=True):
            out[k] = len(ids)
        return out

    def _waves(self, words: list[bytes], width: int) -> list[int]:
        """Number of ids of words of at most ``width`` bytes: each wave makes every word's next merge.

        Words stand in columns. ``keys`` holds the rank and place of the pair that begins at a place, so a column's least
        key is its lowest pair, of equal ones the leftmost. Row ``width`` stands behind every word's end and before its begin.
        """
        pairs, ranks, of_bytes = self._tables
        n = len(words)
        counts = np.fromiter(map(len, words), np.int32, n)
        column = np.repeat(np.arange(n), counts)
        place = np.arange(len(column)) - np.repeat(np.cumsum(counts) - counts, counts)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ids = np.full((width + 1, n), -1, np.int64)
        ids[place, column] = np.array(self.of_byte, np.int64)[data]
        keys = np.full((width, n), _NONE, np.int32)
        left = np.flatnonzero(column[:-1] == column[1:])
        found = of_bytes[data[left] << 8 | data[left + 1]]
        left, found = left[found != _NONE >> _PLACE], found[found != _NONE >> _PLACE]
        keys[place[left], column[left]] = found << _PLACE | place[left]
        rows = np.arange(width + 1, dtype=np.int8)[:, None]
        after = np.where(rows + 1 < counts, rows + np.int8(1), np.int8(width))
        before = np.repeat(np.where(rows > 0, rows - np.int8(1), np.int8(width)), n, axis=1)
        own = np.arange(n)
        while True:
            least = keys.min(axis=0)
            on = np.flatnonzero(least != _NONE)
            if not len(on):
                return counts.tolist()
            if 2 * len(on) < len(own):  # most words are done: the rest move together
                own, least, keys, ids, after, before = own[on], least[on], keys[:, on], ids[:, on], after[:, on], before[:, on]
                on = np.arange(len(own))
            counts[own[on]] -= 1
            at, rank = least[on] & (1 << _PLACE) - 1, (least[on] >> _PLACE).astype(np.int64)
            right = after[at, on]
            behind, ahead = after[right, on], before[at, on]
            ids[at, on], keys[right, on], keys[at, on] = rank, _NONE, _NONE
            after[at, on], before[behind, on] = behind, at
            for where, first, second, pos in ((behind, rank, ids[behind, on], at), (ahead, ids[ahead, on], rank, ahead)):
                there = np.flatnonzero(where < width)
                wanted = first[there] << 32 | second[there]
                found = np.searchsorted(pairs, wanted)
                keys[pos[there], on[there]] = np.where(pairs[found] == wanted, ranks[found] << _PLACE | pos[there], _NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token itself is that token."""
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.encode_bytes(words)]

    def _indexed(self, words: list[bytes]) -> tuple[list[int], list[int], list[int], np.ndarray, dict[int, list[int]]]:
        """Symbols of words that are not empty, their links, the bounds of words, and the index: rank of a pair to where its left part stands."""
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[bounds[1:] - 1] = before[bounds[:-1]] = -1
        found = self._tables[2][data[:-1] << 8 | data[1:]]
        found[bounds[1:-1] - 1] = _NONE >> _PLACE
        left = np.flatnonzero(found != _NONE >> _PLACE)
        left = left[np.argsort(found[left], kind="stable")]
        firsts = np.flatnonzero(np.diff(found[left], prepend=-1))
        ranks, begins, listed = found[left[firsts]].tolist(), firsts.tolist(), left.tolist()
        positions = defaultdict(list, zip(ranks, (listed[a:b] for a, b in zip(begins, [*begins[1:], len(listed)]))))
        return np.array(self.of_byte)[data].tolist(), after.tolist(), before.tolist(), bounds, positions

    def encode_bytes(self, words: list[bytes]) -> list[bytes]:
        """As :meth:`encode`, the ids as little-endian unsigned 32-bit integers."""
        out = [b"" if whole is None else whole.to_bytes(4, "little") for whole in map(self.ranks.get, words)]
        rest = [k for k, word in enumerate(words) if word and not out[k]]
        if not rest:
            return out
        ids, after, before, bounds, positions = self._indexed([words[k] for k in rest])
        merged = self.merges.get
        queue = list(positions)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            todo = positions.pop(rank, None)
            if todo is None:
                continue
            todo.sort()
            for done, at in enumerate(todo):
                left, right = ids[at], after[at]
                if left < 0 or right < 0 or merged(left << 32 | ids[right]) != rank:
                    continue
                ids[at], ids[right] = rank, -1
                behind, ahead, least = after[right], before[at], rank
                after[at] = behind
                if behind >= 0:
                    before[behind] = at
                    if (new := merged(rank << 32 | ids[behind])) is not None:
                        if new not in positions:
                            heappush(queue, new)
                        positions[new].append(at)
                        least = min(least, new)
                if ahead >= 0 and (new := merged(ids[ahead] << 32 | rank)) is not None:
                    if new not in positions:
                        heappush(queue, new)
                    positions[new].append(ahead)
                    least = min(least, new)
                if least < rank:  # an earlier merge became possible: it goes first
                    positions[rank] = todo[done + 1 :]
                    heappush(queue, rank)
                    break
        flat = np.array(ids)  # what was merged into its left neighbour is -1
        ends = np.concatenate([[0], np.cumsum(flat >= 0)])[bounds].tolist()
        blob = flat[flat >= 0].astype("<u4").tobytes()
        for k, begin, end in zip(rest, ends, ends[1:]):
            out[k] = blob[4 * begin : 4 * end]
        return out


class Codec:
    """Whole-text encoder and decoder with a bounded cache of encoded words."""

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        self.replay = MergeReplay(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.cache = WordCache(lambda words: self.replay.encode_bytes([w.encode() for w in words]), cache_bytes, len)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for group in groups(texts, SLICE_CHARS):
            split = [self.pattern.findall(part) for _, part in group]
            self.cache.turn()
            of = self.cache.hold(split).__getitem__
            for (k, _), words in zip(group, split, strict=True):
                out[k].append(b"".join(map(of, words)))
        return [b"".join(ids) for ids in out]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary; built once in each Python process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its id, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for rows, texts in text_slices(batch):
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr(f"`{id_column}` AS doc_id", f"`{text_column}` AS text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As :func:`encode_documents`, with digests made where the ids are, so that neither ids nor bytes leave the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for rows, texts in text_slices(batch):
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    return digest_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
