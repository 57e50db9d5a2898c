"""Retrieval metrics on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_inside(actual: Column, expected: Column) -> Column:
    """Whether the text holds any of the expected strings, whatever the case."""
    return F.exists(expected, lambda e: F.contains(F.lower(actual), F.lower(e)))


def source_recall(expected: Column, actual: Column) -> Column:
    hits = F.size(F.filter(expected, lambda e: F.exists(actual, lambda a: F.contains(F.lower(a), F.lower(e)))))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(hits / F.size(expected))


def recall_at(expected: Column, actual: Column, k: int) -> Column:
    return F.when(F.exists(F.slice(actual, 1, k), lambda a: _any_inside(a, expected)), F.lit(1.0)).otherwise(F.lit(0.0))


def keyword_rate(keywords: Column, answer: Column) -> Column:
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) == 0, F.lit(1.0)).otherwise(hits / F.size(keywords))


def reciprocal_rank(expected: Column, actual: Column) -> Column:
    at = F.array_position(F.transform(actual, lambda a: _any_inside(a, expected)), True)
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def judge_score(reply: Column) -> Column:
    """The first of 0, 1, 2 in a judge's reply, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(reply, "[012]", 0), F.lit("")).cast("int"), F.lit(-1))


def counted_mean(value: Column) -> Column:
    """Mean of the values that are not negative; 0 if there is none."""
    return F.coalesce(F.avg(F.when(value >= 0, value)), F.lit(0.0))


def dropped(previous: Column, current: Column, threshold: float = 0.10) -> Column:
    """Whether a metric fell by more than the share; a previous 0 or null never counts."""
    return F.coalesce((previous - current) / F.nullif(previous, F.lit(0.0)) > threshold, F.lit(False))
