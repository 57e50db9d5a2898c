"""Event streams by topic pattern; the same columns from files where no broker is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import INDEXING_EVENT

PATTERN = r"indexing\.shared|indexing\.enterprise\..*"


def topic(tenant: Column, tier: Column) -> Column:
    return F.when(tier == "ENTERPRISE", F.concat(F.lit("indexing.enterprise."), F.lower(tenant))).otherwise(F.lit("indexing.shared"))


def read_events(spark: SparkSession, servers: str, most: int = 500) -> DataFrame:
    """Stream of parsed events with topic and headers; a broken value gives a null event, not a failed batch."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", PATTERN)
        .option("maxOffsetsPerTrigger", most)
        .option("includeHeaders", "true")
        .load()
    )
    return parsed(raw)


def parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("event", F.from_json(F.col("value").cast("string"), INDEXING_EVENT))


def read_event_files(spark: SparkSession, folder: str, most_files: int = 10) -> DataFrame:
    return spark.readStream.schema(INDEXING_EVENT).option("maxFilesPerTrigger", most_files).json(folder)


def outgoing(events: DataFrame) -> DataFrame:
    """Rows for the sink: topic by tier, key by tenant, the event as JSON."""
    body = F.to_json(F.struct(*[c for c in events.columns]))
    return events.select(topic(F.col("tenant_id"), F.col("tier")).alias("topic"), F.col("tenant_id").alias("key"), body.alias("value"))


def write_events(events: DataFrame, servers: str, checkpoint: str):
    return outgoing(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
