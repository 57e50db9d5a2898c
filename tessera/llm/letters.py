"""Columns and samples shared by the two text classifiers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters_only(text: Column) -> Column:
    """Lower-cased words of letters with single spaces between and around them; empty where there is no letter."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(F.coalesce(words, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the fold of a row."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


#: Most classes that a sample is drawn of, the commonest first: a dirty label column brings no more to the driver.
MOST_CLASSES = 256


def class_sample(rows: DataFrame, label: str, quota: dict | int, key: str = "doc_id", classes: int = MOST_CLASSES) -> DataFrame:
    """About ``quota`` keys of each of the ``classes`` commonest classes (all, if it has fewer), the same on every run.

    One aggregation counts the different keys of each class, to a few hundredths; a row stays if the hash of its key falls under its
    class's share. Rows that repeat a key are one (the least), so a key on any number of rows neither takes the place of
    others nor brings more than one row. ``quota`` is one number or one for each class.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(label).agg(F.approx_count_distinct(key, 0.02).alias("n"))
    unit = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    stays = F.lit(False)
    for value, n in counts.orderBy(F.desc("n"), label).limit(classes).collect():
        share = (quota[value] if isinstance(quota, dict) else quota) / max(n, 1)
        stays = stays | ((F.col(label) == F.lit(value)) & (unit < F.lit(min(share, 1.0))))
    columns = [label, *(c for c in rows.columns if c not in (key, label))]
    return rows.filter(stays).groupBy(key).agg(F.min(F.struct(*columns)).alias("__row")).select(*(F.col(key) if c == key else F.col("__row")[c].alias(c) for c in rows.columns))


#: Bytes of prepared text that are worked on at once.
PIECE = 1 << 18


def bounded(texts: list[str], limit: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Prepared texts in groups of about ``limit`` characters: (which text, piece of it). A longer text comes in several pieces, cut at
    spaces that both sides keep, so every word has its surroundings."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for owner, text in enumerate(texts):
        at = 0
        while at >= 0:
            cut = text.find(" ", at + limit) if len(text) - at > limit else -1
            cut = -1 if cut == len(text) - 1 else cut
            parts.append(text[at : cut + 1] if cut >= 0 else text[at:] if at else text)
            owners.append(owner)
            held, at = held + len(parts[-1]), cut
            if held >= limit:
                yield owners, parts
                owners, parts, held = [], [], 0
    if parts:
        yield owners, parts
