"""Rollup of a log store for those on call: hourly counts, the commonest errors of a day, and days on which errors rose.

    out/hourly/day=  lines, errors and pods of each hour, namespace and service
    out/errors/day=  the commonest error messages of each namespace
    out/daily/day=   lines and errors of each namespace, its commonest error, and its share of errors against the last day before it that has lines

A run replaces the days it is asked for (all, without bounds) and nothing else, so late lines are taken by running a day
again, and any run may be repeated. ``daily`` is made from the hourly table as it then stands, since a day's change shows
in the comparison of the day after it.

    python -m jobs.log_rollup --events s3a://lake/events --out s3a://lake/rollup [--since 2024-01-01] [--until 2024-02-01] [--config own.json]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import configured, session
from tessera.operators.logs import renamed
from tessera.sources.tables import replace_partitions, table

log = logging.getLogger("log_rollup")

HOURLY = "hour int, namespace string, service string, n long, n_errors long, n_pods long, day date"
ERRORS = "namespace string, message string, n long, place int, day date"
DAILY = "namespace string, n long, n_errors long, error_share double, previous_share double, regressed boolean, top_error string, top_error_n long, day date"


def records(events: DataFrame, config: dict) -> DataFrame:
    """Log records of an events table, under the standard names, each with its day."""
    own = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin(config["error_types"]), "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("ns-"), (F.col("user_id") % config["namespaces"]).cast("string")).alias("namespace"),
        F.concat(F.lit("svc-"), (F.col("user_id") % config["services"]).cast("string")).alias("service"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
    )
    return renamed(own, config["columns"]).withColumn("day", F.to_date("ts"))


def hourly(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", F.hour("ts").alias("hour"), "namespace", "service").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "ERROR").alias("n_errors"), F.countDistinct("pod").alias("n_pods"))


def commonest(rows: DataFrame, most: int) -> DataFrame:
    """The commonest error messages of each day and namespace; the first by spelling among equals."""
    counts = rows.filter("level = 'ERROR'").groupBy("day", "namespace", "message").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.expr("row_number() OVER (PARTITION BY day, namespace ORDER BY n DESC, message)")).filter(F.col("place") <= most)


def daily(hours: DataFrame, errors: DataFrame, threshold: float) -> DataFrame:
    """Each day and namespace against the last one before it."""
    days = hours.groupBy("day", "namespace").agg(F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors")).withColumn("error_share", F.round(F.col("n_errors") / F.col("n"), 6))
    before = days.withColumn("previous_share", F.expr("lag(error_share) OVER (PARTITION BY namespace ORDER BY day)"))
    rose = F.col("error_share") > F.col("previous_share") * (1 + threshold)
    first = errors.filter("place = 1").select("day", "namespace", F.col("message").alias("top_error"), F.col("n").alias("top_error_n"))
    return before.withColumn("regressed", F.coalesce(rose, F.lit(False))).join(first, ["day", "namespace"], "left")


def run(spark: SparkSession, events: str, out: str, since: str | None = None, until: str | None = None, config: dict | None = None) -> dict[str, int]:
    """Roll up the days from ``since`` up to, but not with, ``until``; returns the rows of each table."""
    config = config or configured(__file__)
    own = spark.read.parquet(events)
    for bound, value in (("ts >= timestamp'{}'", since), ("ts < timestamp'{}'", until)):
        own = own.filter(bound.format(value)) if value else own
    rows = records(own, config)
    log.info("reading %s from %s to %s", events, since or "its first day", until or "its last")
    for name, schema in (("hourly", HOURLY), ("errors", ERRORS)):
        table(spark, f"{out}/{name}", schema)
    replace_partitions(hourly(rows), f"{out}/hourly", "day")
    log.info("%d lines stand in %s/hourly", table(spark, f"{out}/hourly", HOURLY).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], out)
    replace_partitions(commonest(rows, config["top_errors"]), f"{out}/errors", "day")
    replace_partitions(daily(table(spark, f"{out}/hourly", HOURLY), table(spark, f"{out}/errors", ERRORS), config["regression"]), f"{out}/daily", "day")
    counts = {name: table(spark, f"{out}/{name}", schema).count() for name, schema in (("hourly", HOURLY), ("errors", ERRORS), ("daily", DAILY))}
    log.info("done: %s", counts)
    return counts


def rollup(spark: SparkSession, out: str) -> DataFrame:
    """All three tables, by their grain."""
    parts = [table(spark, f"{out}/{name}", schema).withColumn("grain", F.lit(name)) for name, schema in (("hourly", HOURLY), ("errors", ERRORS), ("daily", DAILY))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--events", required=True, help="Parquet table of log events")
    parser.add_argument("--out", required=True, help="folder of the tables")
    parser.add_argument("--since", help="first day")
    parser.add_argument("--until", help="day after the last")
    parser.add_argument("--config", help="JSON file with settings that differ from jobs/log_rollup.json")
    own = parser.parse_args()
    spark = session("log_rollup")
    try:
        run(spark, own.events, own.out, own.since, own.until, configured(__file__, own.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
