"""Arrow plumbing shared by the operators: bounded slices of text; tables in the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.scratch import stored  # noqa: F401  the operators take it from here

#: Characters of text that one slice of a batch holds, unless a single text is longer.
SLICE_CHARS = 1 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive row ranges of a batch with their texts (null becomes empty), each of about ``limit`` characters.

    Intermediate arrays of a slice stay small whatever the batch size; one longer text makes a slice of its own.
    """
    texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > limit:
            yield batch.slice(start, i - start), texts[start:i]
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


#: Bytes of one Arrow batch between the JVM and Python, where the session has no bound of its own: rows of a batch are
#: counted by default, and a few thousand texts take more memory than the operators themselves.
BATCH_BYTES = 4 << 20
_BOUND, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BOUND) == _DEFAULT:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
