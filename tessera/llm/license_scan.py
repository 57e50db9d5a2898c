"""License scans by diagonal voting.

Rolling hashes of all k consecutive words of every whole text meet the k-grams of the templates in one Spark join
(k = 2 for the base phrases, ``GRAM`` for the longer notices). A hit at word w of a text and word t of a template votes
for the diagonal w - t; votes are gathered as a bit for each template position. Neighbouring diagonals of a template
(at most ``DRIFT`` apart: words were inserted or left out) are merged, and a span is kept if the grams of their bits
cover enough words of the template, and all that tell it from others: its numbers and the words of its label, so the notice
of another version isn't taken for it. A base phrase counts only on a single complete diagonal.

Only the templates are broadcast; their size is that of the template list. Votes are keyed by id and a hash of the text,
so a phrase that stands in every document deals its votes over all documents, and repeated rows share the votes of
one and each get a result. Null and empty texts have no words and no places; very long texts are scanned whole, a document at
a time. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.columnar import documents, text_slices
from tessera.llm.words import rolling, word_hashes

GRAM, DRIFT, COVERAGE = 3, 3, 0.75

# The base phrases with their labels, and wording of public license notices.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}


def telling(phrase: str, label: str) -> int:
    """A bit for each word of a notice that tells its label from others: its numbers, and what the label itself is made of."""
    own = set(re.split(r"[-.]", label))
    return sum(1 << i for i, w in enumerate(phrase.split()) if w in own or any(c.isdigit() for c in w))


def template_rows(base: dict[str, str], notices: dict[str, str]) -> list[tuple[int, int, int, int, str, bool, int]]:
    """(gram, template, position, number of words, label, whether base, telling words) of all grams of all templates."""
    rows = []
    for number, (phrase, label, is_base) in enumerate([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items()]):
        k = 2 if is_base else GRAM
        grams, _ = rolling(*word_hashes([phrase]), k, salt=k)
        if not 1 <= len(grams) <= 63 - k:
            raise ValueError(f"a template has {k} words at least and 62 at most: {phrase!r}")
        rows += [(int(g), number, position, len(grams) + k - 1, label, is_base, telling(phrase, label)) for position, g in enumerate(grams.view(np.int64).tolist())]
    return rows


def grams(docs: DataFrame) -> DataFrame:
    """All rolling grams of all texts (doc_id, key, place, gram), and for each document a row without a gram whose place is its number of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "place", "gram"]
        for batch in batches:
            for rows, texts in text_slices(batch):
                hashes, bounds = word_hashes(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(bounds)), pa.nulls(len(rows), pa.int64())], names)
                for k in (2, GRAM):
                    found, edges = rolling(hashes, bounds, k, salt=k)
                    of = np.repeat(np.arange(len(rows)), np.diff(edges))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of)), rows.column(1).take(pa.array(of)), pa.array(np.arange(len(found)) - edges[of]), pa.array(found.view(np.int64))], names)

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, place long, gram long")


def covered(k: int) -> str:
    """The template words under the hits: each hit of a k-gram covers k of them."""
    return "(" + " | ".join(f"shiftleft(bits, {j})" for j in range(k)) + ")"


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """(spans, documents): every verified span with its template's label and coverage, and one row for each document."""
    spark = docs.sparkSession
    rows = template_rows(base, notices)
    positions = F.broadcast(spark.createDataFrame([r[:3] for r in rows], "gram long, template int, position int"))
    templates = F.broadcast(spark.createDataFrame(sorted({(r[1], *r[3:]) for r in rows}), "template int, size int, label string, is_base boolean, telling long"))
    hits = grams(docs).join(positions, "gram", "left").filter("gram IS NULL OR template IS NOT NULL")
    votes = (
        hits.groupBy("doc_id", "key", "template", F.expr("CASE WHEN gram IS NOT NULL THEN place - position END").alias("diagonal"))
        .agg(
            F.expr("bit_or(CASE WHEN gram IS NULL THEN 0L ELSE shiftleft(1L, position) END)").alias("bits"),
            F.expr("max(CASE WHEN gram IS NULL THEN place END)").alias("n_words"),
            F.expr("sum(CASE WHEN gram IS NULL THEN 1 ELSE 0 END)").alias("rows"),
        )
        .join(templates, "template", "left")
    )
    own = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.col("is_base") | F.col("before").isNull() | (F.col("diagonal") - F.col("before") > DRIFT)
    merged = (
        votes.withColumn("before", F.lag("diagonal").over(own))
        .withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(own))
        .groupBy("doc_id", "key", "template", "span", "size", "is_base", "telling")
        .agg(F.bit_or("bits").alias("bits"), F.min("diagonal").alias("first"), F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.max("label").alias("label"))
        .withColumn("words", F.expr(f"CASE WHEN is_base THEN {covered(2)} ELSE {covered(GRAM)} END"))
        .withColumn("coverage", F.expr("bit_count(words) / size"))
        .filter(f"template IS NULL OR coverage = 1 OR (NOT is_base AND coverage >= {COVERAGE} AND words & telling = telling)")
    )
    spans = merged.filter("template IS NOT NULL").select("doc_id", "key", "template", "label", "is_base", "first", "coverage")
    found = (
        merged.groupBy("doc_id", "key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.max("rows").alias("rows"),
            F.count_if("is_base").alias("n_base"),
            F.expr("min(CASE WHEN is_base THEN first END)").alias("first_word"),
            F.expr("max(CASE WHEN is_base THEN first END)").alias("last_word"),
            F.expr("array_join(array_sort(collect_set(CASE WHEN is_base THEN label END)), ',')").alias("base_labels"),
            F.expr("array_join(array_sort(collect_set(label)), ',')").alias("labels"),
            F.coalesce(F.max(F.expr("CASE WHEN template IS NOT NULL THEN coverage END")), F.lit(0.0)).alias("score"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    )
    return spans, found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every whole text of ``documents``."""
    return scan(documents(spark, sf_dir))[1]
