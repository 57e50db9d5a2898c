"""The hits page: order, offset and keyset paging, cursors, totals, facets."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100
FACETS = {"tags", "author", "lang", "source"}


def page(scored: DataFrame, size: int, number: int = 0, key: str = "doc_id", cursor: str | None = None) -> DataFrame:
    """One page by score, then key. With a cursor the page number is ignored; a broken cursor is as none."""
    size = max(1, min(size, MAX_PAGE))
    after = read_cursor(cursor) if cursor else []
    if after:
        score, last = float(after[0]), after[1]
        return scored.filter((F.col("score") < score) | ((F.col("score") == score) & (F.col(key) > F.lit(last).cast(scored.schema[key].dataType)))).orderBy(F.desc("score"), key).limit(size)
    return scored.orderBy(F.desc("score"), key).offset(max(0, number) * size).limit(size)


def cursor_column(score: Column, key: Column) -> Column:
    """The cursor of a row: a JSON array of two strings in base 64 for urls, without padding."""
    text = F.to_json(F.array(score.cast("string"), key.cast("string")))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def read_cursor(cursor: str) -> list[str]:
    """Score and key of a cursor; empty if it is malformed."""
    try:
        value = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return value if isinstance(value, list) and len(value) == 2 and float(value[0]) == float(value[0]) else []
    except (ValueError, TypeError):
        return []


def next_cursor(rows: list, size: int, key: str = "doc_id") -> str | None:
    """Only a full page has a next one."""
    if len(rows) < size or not rows:
        return None
    text = json.dumps([str(rows[-1]["score"]), str(rows[-1][key])], separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def total(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("total"))


def facets(matches: DataFrame, fields: list[str], key: str = "doc_id", size: int = 20) -> DataFrame:
    """(facet, value, n): the commonest values of each known field among the matches; array fields count each element."""
    parts = []
    for field in fields:
        if field not in FACETS or field not in matches.columns:
            continue
        many = matches.schema[field].dataType.typeName() == "array"
        values = matches.select(key, (F.explode(field) if many else F.col(field)).alias("value")).filter("value IS NOT NULL")
        counts = values.groupBy("value").agg((F.countDistinct(key) if many else F.count("*")).alias("n"))
        parts.append(counts.orderBy(F.desc("n"), "value").limit(size).select(F.lit(field).alias("facet"), "value", "n"))
    out = parts[0] if parts else matches.sparkSession.createDataFrame([], "facet string, value string, n long")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
