"""The customer registry as a table: partial updates, environments, lifecycle, aliases, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import plain_name
from tessera.schemas import LIFECYCLE, LIFECYCLE_LABELS, choice, stage_ordinal

UPDATABLE = ("name", "lifecycle_stage", "products", "notes", "aliases")


def create(customers: DataFrame, additions: DataFrame) -> DataFrame:
    """New customers; one whose id exists is left out."""
    return customers.unionByName(additions.join(customers.select("id"), "id", "left_anti").select(*customers.columns))


def delete(customers: DataFrame, ids: DataFrame) -> DataFrame:
    return customers.join(ids.select("id"), "id", "left_anti")


def update(customers: DataFrame, changes: DataFrame) -> DataFrame:
    """Non-null values of the updatable columns that ``changes`` has; everything else stays."""
    own = [c for c in UPDATABLE if c in changes.columns]
    new = changes.select("id", *(F.col(c).alias(f"new_{c}") for c in own))
    rows = customers.join(new, "id", "left")
    return rows.select(*(F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in customers.columns))


def unknown_products(customers: DataFrame, known: list[str]) -> DataFrame:
    """(id, unknown): customers that name products which the catalogue lacks."""
    return customers.select("id", F.array_except("products", F.array(*map(F.lit, known))).alias("unknown")).filter(F.size("unknown") > 0)


def advanced(stage: Column, env: Column) -> Column:
    """The later of the two stages: a lifecycle never goes back."""
    return F.when(stage_ordinal(env) > stage_ordinal(stage), env).otherwise(stage)


def upsert_environments(customers: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (id, env, settings map) merged over each customer's environments, non-blank values first; stages advance."""
    folded = updates.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("env", "settings"))).alias("fresh"))  # an entry for each environment
    rows = customers.join(folded, "id", "left")
    none = F.create_map().cast("map<string,map<string,string>>")
    own, fresh = F.coalesce("environments", none), F.coalesce("fresh", none)
    empty = F.create_map().cast("map<string,string>")
    setting = lambda a, b: F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(F.nullif(y, F.lit("")), x))
    both = F.map_zip_with(own, fresh, lambda _, a, b: setting(a, b))
    best = F.aggregate(F.map_keys(fresh), F.col("lifecycle_stage"), lambda s, e: advanced(s, e))
    return rows.select(*(both.alias(c) if c == "environments" else best.alias(c) if c == "lifecycle_stage" else F.col(c) for c in customers.columns))


def highest_environment(environments: Column) -> Column:
    """The most advanced configured environment."""
    ranked = F.transform(F.map_keys(environments), lambda e: F.struct(stage_ordinal(e).alias("ordinal"), e.alias("env")))
    return F.array_max(ranked)["env"]


def resolved_environment(environments: Column, requested: Column) -> Column:
    """The requested environment if configured, else the most advanced one, else null."""
    return F.when(F.map_contains_key(environments, requested), requested).otherwise(highest_environment(environments))


def environment_listing(customers: DataFrame) -> DataFrame:
    """(id, configured, missing): environments in lifecycle order."""
    stages = F.array(*map(F.lit, LIFECYCLE[1:]))
    names = F.map_keys("environments")
    return customers.select("id", F.array_intersect(stages, names).alias("configured"), F.array_except(stages, names).alias("missing"))


def normalised(flat: DataFrame) -> DataFrame:
    """Flat records (k8s_* columns on the customer) in the nested form, under the record's own environment or prod."""
    env = F.coalesce(F.nullif("env", F.lit("")), F.lit("prod"))
    settings = F.map_filter(F.create_map(*(x for c in flat.columns if c.startswith("k8s_") for x in (F.lit(c), F.col(c)))), lambda _, v: F.coalesce(v, F.lit("")) != "")
    return flat.select("id", F.coalesce("name", "id").alias("name"), F.coalesce("lifecycle_stage", env).alias("lifecycle_stage"), F.create_map(env, settings).alias("environments"))


def learned_alias(aliases: Column, phrase: Column) -> Column:
    """The aliases with the phrase appended, unless an equal one is there after normalisation or it is blank."""
    own = F.coalesce(aliases, F.array().cast("array<string>"))
    known = F.exists(own, lambda a: plain_name(a) == plain_name(phrase))
    return F.when(known | (plain_name(phrase) == ""), own).otherwise(F.array_append(own, phrase))


def lifecycle_label(stage: Column) -> Column:
    return F.coalesce(choice(stage, LIFECYCLE_LABELS, None), stage)
