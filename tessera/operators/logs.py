"""Log, deployment and pod queries over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import image_version, log_line
from tessera.operators.bm25 import all_terms

DEFAULT_FIELDS = {"timestamp": "ts", "message": "message", "level": "level", "namespace": "namespace", "pod": "pod", "container": "container", "app": "app"}


def renamed(logs: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Columns under their standard names; overrides say what a store calls them."""
    fields = DEFAULT_FIELDS | {k: v for k, v in (overrides or {}).items() if v}
    return logs.withColumnsRenamed({v: DEFAULT_FIELDS[k] for k, v in fields.items() if v != DEFAULT_FIELDS[k]})


def matching(logs: DataFrame, as_of: Column, minutes: int = 30, namespace: str | None = None, service: str | None = None, level: str | None = None, grep: str | None = None) -> DataFrame:
    """Records of the last minutes that pass every given filter; all are plain predicates for the scan."""
    out = logs.filter(F.col("ts").between(as_of - F.expr(f"INTERVAL {minutes} MINUTES"), as_of))
    if namespace:
        out = out.filter(F.col("namespace") == namespace)
    if service:
        out = out.filter(F.col("pod").startswith(service))
    if level:
        out = out.filter(F.col("level") == level.upper())
    if grep:
        out = out.filter(all_terms(F.col("message"), [t for t in grep.lower().split() if t]))
    return out


def newest(logs: DataFrame, size: int = 300, key: str = "event_id") -> DataFrame:
    return logs.orderBy(F.desc("ts"), key).limit(size)


def relaxed(logs: DataFrame, as_of: Column, namespace: str, **filters) -> DataFrame:
    """As :func:`matching`; if the namespace leaves nothing, the records without that filter. One plan, no driver branch."""
    wide = matching(logs, as_of, **filters)
    hit = wide.agg(F.count_if(F.col("namespace") == namespace).alias("hits"))  # one row
    return wide.crossJoin(F.broadcast(hit)).filter((F.col("hits") == 0) | (F.col("namespace") == namespace)).drop("hits")


def formatted(logs: DataFrame) -> DataFrame:
    return logs.select(log_line(F.col("ts"), F.col("level"), F.col("pod"), F.col("message")).alias("line"))


def indices(logs: DataFrame, index: str = "index_name") -> DataFrame:
    return logs.groupBy(index).agg(F.count("*").alias("docs"), F.sum(F.length("message")).alias("bytes"))


def tail(logs: DataFrame, prefix: str, pods: int = 3, lines: int = 200, most: int = 400, grep: str | None = None, key: str = "event_id") -> DataFrame:
    """The last lines of the first pods with the prefix, filtered by a substring in any case, newest last ``most``."""
    own = logs.filter(F.col("pod").startswith(prefix))
    named = own.select("pod").distinct().orderBy("pod").limit(pods)
    place = F.expr(f"row_number() OVER (PARTITION BY pod ORDER BY ts DESC, {key} DESC)")
    out = own.join(F.broadcast(named), "pod").withColumn("place", place).filter(F.col("place") <= lines).drop("place")  # at most ``pods`` rows
    if grep:
        out = out.filter(F.lower("message").contains(grep.lower()))
    return out.orderBy(F.desc("ts"), F.desc(key)).limit(most)


def deployments(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, image, version, ready, desired) of tab-separated lines; lines with fewer than two fields are left out."""
    parts = F.split(F.trim(line), "\t")
    rows = lines.withColumn("parts", parts).filter(F.size("parts") >= 2)
    pods = F.coalesce(F.get("parts", F.lit(2)), F.lit("?/?"))
    return rows.select(
        *[c for c in lines.columns if c != line],
        F.get("parts", F.lit(0)).alias("name"),
        F.get("parts", F.lit(1)).alias("image"),
        image_version(F.get("parts", F.lit(1))).alias("version"),
        F.split(pods, "/").getItem(0).try_cast("int").alias("ready"),
        F.get(F.split(pods, "/"), F.lit(1)).try_cast("int").alias("desired"),
        pods.alias("pods"),
    )


def deployment_summary(rows: DataFrame) -> DataFrame:
    """(customer, env, content): one document of deployed versions for each customer and environment, in name order."""
    entry = F.struct("name", F.concat(F.lit("  "), "name", F.lit(": "), "version", F.lit("  ("), "pods", F.lit(" pods)")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "\n")  # a customer's deployments
    head = F.concat(F.lit("Customer: "), "customer", F.lit("\nEnvironment: "), "env", F.lit("\n\nDEPLOYED VERSIONS:\n"))
    return rows.groupBy("customer", "env").agg(joined.alias("body")).select("customer", "env", F.concat(head, "body").alias("content"))


def pods(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, ready, status, restarts) of white-space separated pod lines."""
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.withColumn("parts", parts).filter(F.size("parts") >= 4)
    item = lambda i: F.get("parts", F.lit(i))
    return rows.select(*[c for c in lines.columns if c != line], item(0).alias("name"), item(1).alias("ready"), item(2).alias("status"), item(3).try_cast("int").alias("restarts"))


def unhealthy(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("status") != "Running") | (F.col("restarts") > 5))
