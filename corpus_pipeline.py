"""The corpus pipeline: toxic documents go, then unrecognised languages, then near duplicates; what stays is packed.

Null and empty texts pass the first stage and go in the second. Repeated rows and copies leave one document. Extra columns
pass all stages but the last, whatever their names. An empty table gives no pieces. Very long texts are read whole by each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.columnar import bound_batches, stored
from tessera.llm.language_id import language_stage
from tessera.llm.ngram_join import near_duplicate_stage
from tessera.llm.packing import pack
from tessera.llm.toxicity import toxicity_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequences; a null text is an empty one, extra columns end here."""
    bound_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


#: All but the last return the columns of documents; each is written as Parquet and read again as the next one's docs.
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: No stage can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
