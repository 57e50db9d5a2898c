"""Evaluation runs and regressions between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.metrics import counted_mean, dropped, keyword_rate, recall_at, reciprocal_rank, source_recall
from tessera.schemas import EVAL_ITEM

TRACKED = ["source_recall", "recall_at_20", "keyword_hit", "judge_score", "pass_rate"]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_ITEM).option("multiLine", "true").json(path)


def write_results(metrics: DataFrame, folder: str, run: str) -> None:
    """One folder a run: results of earlier runs stay for comparison."""
    metrics.write.mode("overwrite").json(f"{folder}/run={run}")


def item_metrics(items: DataFrame) -> DataFrame:
    """Per item: expected_sources, actual_sources, keywords, answer and judge_score give the metrics."""
    return items.select(
        "id",
        F.round(source_recall(F.col("expected_sources"), F.col("actual_sources")), 6).alias("source_recall"),
        recall_at(F.col("expected_sources"), F.col("actual_sources"), 20).alias("recall_at_20"),
        F.round(reciprocal_rank(F.col("expected_sources"), F.col("actual_sources")), 6).alias("rr"),
        F.round(keyword_rate(F.col("keywords"), F.col("answer")), 6).alias("keyword_hit"),
        "judge_score",
    )


def summary(metrics: DataFrame) -> DataFrame:
    means = [F.round(counted_mean(F.col(c)), 6).alias(c) for c in ("source_recall", "recall_at_20", "rr", "keyword_hit", "judge_score")]
    return metrics.agg(F.count("*").alias("n"), *means, F.round(F.coalesce(F.avg((F.col("judge_score") >= 1).cast("int")), F.lit(0.0)), 6).alias("pass_rate"))


def regressions(runs: DataFrame, metrics: list[str], order: str = "run", threshold: float = 0.10) -> DataFrame:
    """(run, metric, previous, current, regressed): every tracked metric against the run before it. Runs are few."""
    long = runs.unpivot([order], metrics, "metric", "current")
    rows = long.withColumn("previous", F.expr(f"lag(current) OVER (PARTITION BY metric ORDER BY `{order}`)"))
    return rows.select(order, "metric", "previous", "current", dropped(F.col("previous"), F.col("current"), threshold).alias("regressed"))
