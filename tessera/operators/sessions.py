"""Sessions and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_MINUTES, KEPT_TURNS, COMPRESS_AT = 30, 5, 10


def split_sessions(events: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", minutes: int = TTL_MINUTES) -> DataFrame:
    """Adds session_no: a new one begins after more than the given silence."""
    own = Window.partitionBy(key).orderBy(time, order)
    silent = F.unix_millis(F.col(time).cast("timestamp")) - F.lag(F.unix_millis(F.col(time).cast("timestamp"))).over(own)
    return events.withColumn("__new", F.when(silent > minutes * 60_000, 1).otherwise(0)).withColumn("session_no", F.sum("__new").over(own)).drop("__new")


def session_windows(events: DataFrame, key: str = "user_id", time: str = "ts", minutes: int = TTL_MINUTES) -> DataFrame:
    """(key, started, last_active, n) by the built-in session window; also serves streams."""
    window = F.session_window(F.col(time).cast("timestamp"), f"{minutes} minutes")
    return events.groupBy(key, window.alias("w")).agg(F.min(time).alias("started"), F.max(time).alias("last_active"), F.count("*").alias("n")).drop("w")


def recent_turns(turns: DataFrame, keep: int = KEPT_TURNS, key: str = "conv_id", order: str = "turn") -> DataFrame:
    place = F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY `{order}` DESC)")
    return turns.withColumn("__place", place).filter(F.col("__place") <= keep).drop("__place")


def compression_due(turns: DataFrame, at: int = COMPRESS_AT, keep: int = KEPT_TURNS, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, turns, due, to_compress): whether the history is long enough, and how many turns would be summarised."""
    counts = turns.groupBy(key).agg(F.count("*").alias("turns"))
    due = F.col("turns") >= at
    return counts.select(key, "turns", due.alias("due"), F.when(due, F.col("turns") - keep).otherwise(0).alias("to_compress"))


def merged_memory(old: Column, new: Column) -> Column:
    """Values of both maps, the newer one unless blank."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(F.nullif(b, F.lit("")), a))


def merged_findings(old: Column, new: Column, most: int = 5) -> Column:
    """Both lists without repeats, the last ones kept."""
    both = F.array_distinct(F.concat(old, new))
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), F.lit(most))
