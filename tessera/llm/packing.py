"""Sequence packing by minimum bin slack.

Documents are tokenized where they lie and cut into full windows and one remainder each. What the driver sees is the
histogram of piece lengths (at most ``capacity`` numbers whatever the corpus holds). A bitset subset-sum dynamic
programme takes the longest length left, finds the multiset of remaining lengths that fills its window closest to
capacity, backtracks the counts, and uses that pattern for as many windows as the histogram allows. Pieces then get
their window from their rank within their length; a length is ranked in as many salted tasks as its count asks for.

Null and empty texts are documents of the closing id alone. Very long texts are split into words in parts, so that only
their ids are held whole. Repeated rows, also those without a doc_id, are packed as often as they stand there. An empty
table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tessera.llm.columnar import documents, stored, text_slices
from tessera.llm.word_cache import WordCache, groups

#: Pieces of one length that are ranked in one task; a length that more pieces share is dealt over more salts.
RANKED_ROWS = 100_000
#: Bytes of each generation of a worker's word cache.
CACHE_BYTES = 48 << 20
#: Words that the library merges in one call: it takes longer for each in long texts.
MERGED_WORDS = 300
#: Fixed value: the pre-tokenizer pattern that the vocabulary's description names.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The same pattern where a text has only characters outside UNCOMMON: there the faster standard module splits alike.
COMMON_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-z0-9ß-öø-ɏ]+")
UNCOMMON = re.compile(r"[^\t-\r -~×÷ß-öø-ɏ]")


def lowered(text: str) -> str:
    """Lower case character by character: a final sigma is not told apart."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class WordTokens:
    """The ids of a word-end BPE, word by word, with a bounded cache of the words already encoded.

    Literals of the vocabulary's added tokens are cut out of the raw text first and keep their own ids. Words are split
    and lower-cased here and meet only the merges of the library; a text with a character that the library classes or
    normalises otherwise (letters newer than its Unicode tables) is encoded by the library as a whole.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("the vocabulary has added tokens that are not plain literals")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        literals = sorted(self.added, key=len, reverse=True)  # the longest of those that begin at one place
        self.literals = re.compile(f"({'|'.join(map(re.escape, literals))})") if literals else None
        self.normalizer, self.splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.tokenizer.model._resize_cache(0)  # words are cached here
        self.merges = Tokenizer(self.tokenizer.model)  # shares the vocabulary
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.words = regex.compile(WORD_PATTERN)
        self.agreed: dict[str, bool] = {}  # of uncommon characters: whether the library sees them as we do
        self.cache = WordCache(self._learn, cache_bytes, len)

    def _agrees(self, c: str) -> bool:
        own = lowered(unicodedata.normalize("NFC", c))
        split = lambda found: [piece for piece, _ in found]
        like = lambda x: split(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(x))
        if c.isspace():
            return True
        return self.normalizer.normalize_str(c) == own and all(
            [p for w in self.words.findall(x) for p in like(w)] == split(self.splitter.pre_tokenize_str(x)) for x in (f"a{own}b", f"1{own}1", f"-{own}-")
        )

    def _foreign(self, text: str) -> bool:
        """Whether the library has to encode this text itself."""
        seen = set(text)
        for c in seen.difference(self.agreed):
            self.agreed[c] = self._agrees(c)
        return not all(map(self.agreed.__getitem__, seen))

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, ``MERGED_WORDS`` at a time."""
        out: list[bytes] = []
        for at in range(0, len(words), MERGED_WORDS):
            own = words[at : at + MERGED_WORDS]
            ids = np.array(self.merges.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(cuts) != len(own) + 1 or cuts[-1] != 4 * len(ids):
                raise ValueError("the vocabulary does not mark the ends of words")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _split(self, text: str) -> list[str] | None:
        """Words of a text; None for a foreign one."""
        plain = lowered(unicodedata.normalize("NFC", text))
        if not UNCOMMON.search(plain):
            return COMMON_WORDS.findall(plain)
        return None if self._foreign(text) else self.words.findall(plain)

    def _group(self, texts: list[str]) -> list[bytes]:
        parts = [self.literals.split(t) if self.literals else [t] for t in texts]  # every second part is a literal
        plain = [p for own in parts for p in own[::2]]
        split = [self._split(p) for p in plain]
        self.cache.turn()
        of = self.cache.hold(words for words in split if words).__getitem__
        encoded = iter([self._whole(p) if words is None else b"".join(map(of, words)) for p, words in zip(plain, split, strict=True)])
        return [b"".join(self.added[p] if k % 2 else next(encoded) for k, p in enumerate(own)) for own in parts]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for group in groups(texts):
            for (k, _), ids in zip(group, self._group([part for _, part in group]), strict=True):
                out[k].append(ids)
        return [b"".join(ids) for ids in out]


_tokenizers: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's tokenizer; built once in each Python process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def fill(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to copies in a window) with the number of windows each is used for, until no piece is left."""
    left = {length: n for length, n in counts.items() if n > 0}
    patterns = []
    while left:
        seed = max(left)
        room = capacity - seed
        reach, layers, mask = 1, [], (1 << (room + 1)) - 1
        for length in sorted((x for x in left if x <= room), reverse=True):
            copies = min(left[length] - (length == seed), room // length)
            step = 1
            while copies > 0:
                step = min(step, copies)
                layers.append((length, step, reach))
                reach |= (reach << (step * length)) & mask
                copies -= step
                step *= 2
            if reach >> room:
                break
        total = reach.bit_length() - 1
        pattern = {seed: 1}
        for length, step, earlier in reversed(layers):
            if not earlier >> total & 1:
                total -= step * length
                pattern[length] = pattern.get(length, 0) + step
        windows = min(left[length] // copies for length, copies in pattern.items())
        patterns.append((pattern, windows))
        for length, copies in pattern.items():
            left[length] -= copies * windows
            if not left[length]:
                del left[length]
    return patterns


def intervals(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies a window, first window, offset of the first copy), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for pattern, windows in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, used.get(length, 0), pattern[length], window, offset))
            used[length] = used.get(length, 0) + pattern[length] * windows
            offset += pattern[length] * length
        window += windows
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, path: str, capacity: int, closing_id: int) -> DataFrame:
    """One row a piece: full windows of a document and its remainder, with the checksum of the piece's ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokens(path)
        end = np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            for rows, texts in text_slices(batch):
                out: list[tuple[int, int, int, int, int]] = []
                for k, ids in enumerate(own.encode(texts)):
                    ids += end
                    tokens = len(ids) // 4
                    for start in range(0, tokens, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        out.append((k, start, len(piece) // 4, zlib.crc32(piece), tokens))
                of, *rest = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(of), *rest], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, closing_id: int = 2) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset`` (gapless from 0 within a sequence)."""
    pieces = stored(cut(docs, path, capacity, closing_id).withColumn("at", F.monotonically_increasing_id()), "pieces")
    lengths = stored(pieces.groupBy("length").agg(F.count("*").alias("n")).coalesce(1), "lengths")  # capacity rows at most
    table = intervals(fill({r["length"]: r["n"] for r in lengths.collect()}, capacity))
    salt = F.expr(f"pmod(xxhash64(at), cast(ceil(n / {RANKED_ROWS}) AS long))")
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("salt", salt).drop("n")
    dealt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = dealt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("at"))
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 45) + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 45) + rank, "right") - 1].reshape(-1, 5)
            window, slot = np.divmod(rank - row[:, 1], row[:, 2])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(row[:, 3] + window), pa.array(row[:, 4] + slot * length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "before + within - 1 AS rank").mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all ``documents`` into sequences of at most 4096 tokens."""
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
