"""Embeddings from an exchangeable provider, in Arrow batches; the built-in one hashes words and needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts in, one unit vector each out.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 50
QUERY_PREFIX = "Represent this sentence: "
VERSION = "hashed-words-1"


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """Signed word counts in hashed places, normalised: equal for equal texts on every machine."""
    out = np.zeros((len(texts), size), np.float64)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
            out[row, int.from_bytes(digest[:4], "little") % size] += 1.0 if digest[4] & 1 else -1.0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0).tolist()


def query_vector(question: str, embedder: Embedder = hashed_words) -> list[float]:
    """Questions carry a prefix, passages do not."""
    return embedder([QUERY_PREFIX + question])[0]


def embedded(chunks: DataFrame, text: str, embedder: Embedder = hashed_words, version: str = VERSION) -> DataFrame:
    """Adds embedding and embedding_version, ``BATCH`` texts a call; if a call fails its chunks have no vector but stay searchable by words."""
    kept = [f for f in chunks.schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                rows = batch.slice(at, BATCH)
                texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
                try:
                    vectors = embedder([t or "" for t in texts])
                except Exception:  # noqa: BLE001  a provider's failure costs vectors, not the batch
                    vectors = [None] * len(texts)
                columns = [rows.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([version] * len(texts))], [*(f.name for f in kept), "embedding", "embedding_version"])

    from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

    return chunks.mapInArrow(run, StructType([*kept, StructField("embedding", ArrayType(FloatType())), StructField("embedding_version", StringType())]))
