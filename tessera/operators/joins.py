"""Joins that Spark does not have under one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, order: str, strict: bool = True) -> DataFrame:
    """``left`` with the latest earlier ``value`` of ``right``: one shuffle by key and one sort of both sides together."""
    both = left.select(*by, time, order, F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(2 if not strict else 0).alias("__side")).unionByName(
        right.select(*by, time, F.lit(None).cast(left.schema[order].dataType).alias(order), F.col(value).alias("__value"), F.lit(1).alias("__side"))
    )
    keys = ", ".join(f"`{k}`" for k in by)
    frame = f"OVER (PARTITION BY {keys} ORDER BY `{time}`, __side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return both.withColumn(f"previous_{value}", F.expr(f"last_value(__value, true) {frame}")).filter("__side <> 1").select(*by, time, order, f"previous_{value}")


def mapped(df: DataFrame, dimension: DataFrame, on: str, columns: dict[str, Column]) -> DataFrame:
    """Left join to a dimension; ``columns`` say what stands where it has no row. Broadcast is left to the size of the table."""
    rows = df.join(dimension, on, "left")
    return rows.withColumns({c: F.coalesce(F.col(c), default) for c, default in columns.items()})


def first_token_match(rows: DataFrame, index: DataFrame, words: str = "words") -> DataFrame:
    """(row_id, customer): the customer of the first word that the index (word, customer) knows."""
    found = rows.select("row_id", F.posexplode(words).alias("position", "word")).join(index, "word")
    return found.groupBy("row_id").agg(F.min_by("customer", "position").alias("customer"))
