"""Sync state as a two-column table, and what is due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string"


def rows(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), SCHEMA)


def updated(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state with changed keys; stamps are written only after the work they stand for succeeded."""
    return state.join(changes.select("key"), "key", "left_anti").unionByName(changes)


def due(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.select("job", (F.lit(now) - F.col("last") >= F.col("every")).alias("due"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap by rename: a reader sees the old rows or the new ones."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    files = spark._jvm.org.apache.hadoop.fs
    place, fresh = files.Path(path), files.Path(f"{path}.next")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(place, True)
    if not system.rename(fresh, place):
        raise OSError(f"{path} could not be replaced")
