"""Small configuration files: products and customers from YAML or JSON, in list or mapping form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.state import replace_table

try:
    import yaml
except ImportError:  # JSON is a subset that needs no package
    yaml = None

PRODUCT = "id string, description string, priority string, repos array<string>, pod_prefixes array<string>, jira_projects array<string>"
REGISTRY = "id string, name string, lifecycle_stage string, products array<string>, notes string, aliases array<string>, environments map<string,map<string,string>>"


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())  # one small file


def _entries(text: str, key: str) -> list[dict]:
    value = yaml.safe_load(text) if yaml else json.loads(text)
    value = (value or {}).get(key, value) if isinstance(value, dict) else value or []
    return [{"id": k, **(v or {})} for k, v in value.items()] if isinstance(value, dict) else list(value)


def products(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split(" ")[0] for c in PRODUCT.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in _entries(_text(spark, path), "products")], PRODUCT)


def registry(spark: SparkSession, path: str) -> DataFrame:
    names = ["id", "name", "lifecycle_stage", "products", "notes", "aliases", "environments"]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in _entries(_text(spark, path), "customers")], REGISTRY)


def save_registry(customers: DataFrame, path: str) -> None:
    """The registry as a table, swapped in whole."""
    replace_table(customers, path)
