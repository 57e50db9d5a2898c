"""Connectors turn what issue trackers, wikis, repositories and clusters export into documents. Input is files or tables of the exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.extract import SIGNAL_BRANCHES
from tessera.functions.text import extension, html_to_text, rich_text

# What a repository walk reads and skips.
EXTENSIONS = [".py", ".java", ".ts", ".js", ".md", ".yml", ".yaml", ".sh", ".json", ".txt", ".rst"]
SKIPPED_FOLDERS = [".git", "node_modules", "target", "build", "dist", "vendor", "__pycache__", ".venv"]
MOST_BYTES = 500 * 1024
STALE_DAYS = 180
LINK = "array<struct<url:string,relationship:string>>"
ISSUE = f"issue_key string, project string, summary string, description string, status string, priority string, updated timestamp, fields map<string,array<string>>, remote_links {LINK}, linked_issues array<struct<key:string,label:string>>"
PAGE = "page_id string, parent_id string, space string, title string, html string, updated timestamp"


# --- files ---------------------------------------------------------------------------------------------------------


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Text files under a folder, with path and size; wanted ones only, filtered before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return wanted_files(files).withColumn("text", F.decode("content", "UTF-8")).drop("content")


def wanted_files(files: DataFrame) -> DataFrame:
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return files.filter(extension(F.col("path")).isin(EXTENSIONS) & (F.col("length") <= MOST_BYTES) & ~skipped)


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, path, length, text) of wanted files in .tar.gz archives. An archive is read once, member by member; unwanted members are not decoded."""
    import io
    import tarfile
    from collections.abc import Iterable, Iterator

    import pyarrow as pa

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                    for member in archive:
                        path = member.name
                        if member.isfile() and member.size <= MOST_BYTES and "." + path.rsplit(".", 1)[-1].lower() in EXTENSIONS and not set(path.split("/")) & set(SKIPPED_FOLDERS):
                            text = archive.extractfile(member).read().decode("utf-8", "replace")
                            yield pa.RecordBatch.from_pylist([{"archive": name, "path": path, "length": member.size, "text": text}])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(members, "archive string, path string, length long, text string")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# --- branches and repositories -------------------------------------------------------------------------------------


def matching_branches(branches: DataFrame, patterns: list[str]) -> DataFrame:
    """Branches that fit a glob; the patterns become one expression."""
    like = [F.col("branch").like(p.replace("_", r"\_").replace("*", "%")) for p in patterns]
    return branches.filter(reduce(lambda a, b: a | b, like, F.lit(False)))


def signal_branches(branches: DataFrame) -> DataFrame:
    return matching_branches(branches, SIGNAL_BRANCHES)


def fresh_branches(branches: DataFrame, seen: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    """Branches committed to lately, or followed before: only an unknown stale branch is left out."""
    old = F.col("committed") < as_of - F.expr(f"INTERVAL {days} DAYS")
    known = seen.select("branch").distinct().withColumn("known", F.lit(True))
    return branches.join(known, "branch", "left").filter(~old | F.col("known")).drop("known")


def with_commit_dates(branches: DataFrame, commits: DataFrame) -> DataFrame:
    return branches.join(commits.select("sha", "committed"), "sha", "left")


def repo_products(found: DataFrame, configured: DataFrame) -> DataFrame:
    """(repo, product, priority): configured ones first, else the first topic, else unclassified; unknown ones count as high."""
    rows = found.join(configured, "repo", "full_outer")
    topic = F.try_element_at(F.coalesce("topics", F.array().cast("array<string>")), F.lit(1))
    return rows.select("repo", F.coalesce("product", topic, F.lit("unclassified")).alias("product"), F.coalesce("priority", F.lit("high")).alias("priority"))


def merged_since(prs: DataFrame, since: Column | None = None, most: int = 200) -> DataFrame:
    """The latest merged pull requests of a repository feed."""
    merged = prs.filter("merged_at IS NOT NULL")
    return (merged if since is None else merged.filter(F.col("merged_at") >= since)).orderBy(F.desc("merged_at"), "repo", "number").limit(most)


# --- issues --------------------------------------------------------------------------------------------------------


def changed_issues(issues: DataFrame, project: str, since: Column | None = None, overlap_seconds: int = 60, most: int = 1000) -> DataFrame:
    own = issues.filter(F.col("project") == project)
    if since is not None:
        own = own.filter(F.col("updated") >= since - F.expr(f"INTERVAL {overlap_seconds} SECONDS"))
    return own.orderBy("updated", "issue_key").limit(most)


def custom_fields(issues: DataFrame, names: DataFrame, skipped: tuple[str, ...] = ("rank",)) -> DataFrame:
    """(issue_key, field, values): named fields with a value, in the order of their names."""
    kept = F.map_filter("fields", lambda k, v: ~k.isin(*skipped) & (F.size(v) > 0))
    rows = issues.select("issue_key", F.explode(kept).alias("field_id", "values"))
    return rows.join(names, "field_id").select("issue_key", F.col("name").alias("field"), "values").orderBy("issue_key", "field")


def field_values(value: Column) -> Column:
    """The texts of a custom field's JSON: options, users and lists of them by their value or name, scalars as they are."""
    many = F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull() & (value != "null"), F.array(value))
    named = lambda e: F.coalesce(*(F.get_json_object(e, f"$.{k}") for k in ("value", "name", "displayName")), F.regexp_replace(e, '^"|"$', ""))
    return F.filter(F.transform(F.coalesce(many, F.array().cast("array<string>")), named), lambda v: F.coalesce(v, F.lit("")) != "")


def issue_documents(issues: DataFrame) -> DataFrame:
    """One document an issue: key and state as lines, then the rendered description."""
    title = F.concat(F.lit("["), "issue_key", F.lit("] "), "summary")
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), column) for name, column in (("Issue", "issue_key"), ("Status", "status"), ("Priority", "priority"))))
    return issues.select(F.col("issue_key").alias("source_id"), title.alias("title"), F.lit("jira").alias("source"), F.concat(lines, F.lit("\n\n"), rich_text(F.col("description"))).alias("content"), "updated")


# --- wiki ----------------------------------------------------------------------------------------------------------


def page_tree(pages: DataFrame, root: str, deepest: int = 8, most: int = 500) -> DataFrame:
    """(page_id, depth) below a page, level by level; an equi-join a level, so the plan is bounded by the depth."""
    level = pages.filter(F.col("page_id") == root).select("page_id").withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, deepest):
        level = pages.join(level.select(F.col("page_id").alias("parent_id")), "parent_id", "left_semi").select("page_id").withColumn("depth", F.lit(depth))
        out = out.unionByName(level)
    return out.orderBy("depth", "page_id").limit(most)


def page_documents(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("source_id"), "title", F.lit("confluence").alias("source"), html_to_text(F.col("html")).alias("content"), "space", "updated")
