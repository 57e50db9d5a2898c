"""URL filters by path-template trees.

Every path becomes its segments, with numbers, hashes and mixed identifiers replaced by their shape. A tree of these
is grown for each host, level by level, on counts and never on pages: children whose spread over the next level and
whose labels (none is one) do not differ significantly (likelihood-ratio tests, that of labels smoothed) are merged into
one, whatever their number and weight. A merged child of more than ``BRANCHES`` segments is written as a wildcard. Children of a branch with the same
counts (their profile) are one row of its merge, so a branch with very many small children is still a small task. Labels
are the verdicts of the listed rules on the pages they fit; a template is rejected if the smoothed share of block labels
among its labelled pages reaches ``PURITY``. A page's verdict is its rule's, else its template's.

A null url or one without ``://`` has an empty host and path; it belongs to the template of that empty path. Very long urls are
read whole; segments beyond the depth are one, spelled out. Repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columnar import stored

#: Segments that a template spells out at one level; more are a wildcard that names the least of them.
BRANCHES = 16
#: Levels of the tree that are segments; what lies deeper is one last level, as it stands.
DEPTH = 6
#: Smoothing: weight and value of the prior share of block labels, and the share from which a template is rejected.
WEIGHT, PRIOR, PURITY = 2.0, 0.2, 0.5
#: Critical value of the merge test, as a multiple of its degrees of freedom plus a constant.
PER_DEGREE, CONSTANT = 2.0, 4.0
#: Pages that every category of labels has more in the merge test.
SMOOTHING = 0.05


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return self.host + self.path


# The listed rules.
RULES = [Rule("net", "/", True), Rule("example.net", "/en/", False), Rule("example.com", "/de/", True), Rule("org", "/fr/", False)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with ``rule`` and ``ruled`` (the verdict of the longest rule that fits), both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit("block" if r.block else "allow")).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def shapes(path: Column, depth: int = DEPTH) -> Column:
    """The segments of a path, identifiers replaced by their shape; what lies deeper than ``depth`` is one segment."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    shaped = F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^\d+$"), F.lit("{n}"))
        .when(s.rlike(r"^\d+\.[a-z]{1,5}$"), F.regexp_replace(s, r"^\d+", "{n}"))
        .when(s.rlike(r"^[0-9a-f]{8,}(-[0-9a-f]+)*$"), F.lit("{h}"))
        .when(s.rlike(r"\d"), F.lit("{x}"))
        .otherwise(s),
    )
    rest = F.array_join(F.slice(shaped, depth + 1, F.greatest(F.size(shaped) - depth, F.lit(1))), "/")
    return F.when(F.size(shaped) > depth + 1, F.concat(F.slice(shaped, 1, depth), F.array(rest))).otherwise(shaped)


def ratio(a: dict[str, float], b: dict[str, float]) -> tuple[float, int]:
    """Likelihood ratio of two counts having one distribution, and its degrees of freedom."""
    n, m = sum(a.values()), sum(b.values())
    total, keys = 0.0, {*a, *b}
    for counts, size in ((a, n), (b, m)):
        for key, x in counts.items():
            if x:
                total += 2 * x * math.log(x * (n + m) / size / (a.get(key, 0) + b.get(key, 0)))
    return total, max(len(keys) - 1, 1)


def alike(a: tuple[dict, dict], b: tuple[dict, dict]) -> bool:
    """Whether children of two branches, and their labels, may come from the same distributions.

    A page without a label is a category of its own, and every category of labels counts ``SMOOTHING`` more: a section
    that a rule covers differs from one that none does as soon as there are pages enough to tell.
    """
    spread = ratio(a[0], b[0])
    kinds = {*a[1], *b[1]}
    labels = ratio(*({kind: x[1].get(kind, 0) + SMOOTHING for kind in kinds} for x in (a, b)))
    return all(g <= CONSTANT + PER_DEGREE * d for g, d in (spread, labels))


def merge(profiles: pd.DataFrame) -> pd.DataFrame:
    """Groups of the merged children of one branch; rows are (profile, ends, kinds, least): a profile and its children.

    Each group is named by the least segment of its first profile and comes with its number of segments.
    """
    groups: list[tuple[list[int], tuple[dict, dict]]] = []
    found = []
    for at, r in enumerate(profiles.itertuples()):
        spread: dict[str, int] = {}
        labels: dict[str, int] = {}
        for entry in r.profile.split(","):
            key, *counts = entry.split(":")
            n, labelled, blocked = map(int, counts)
            spread[key] = n
            for name, count in (("block", blocked), ("allow", labelled - blocked), ("none", n - labelled)):
                if count:
                    labels[name] = labels.get(name, 0) + count
        found.append((-sum(spread.values()), r.least, at, spread, labels))
    ends, kinds, least = profiles["ends"].to_numpy(), profiles["kinds"].to_numpy(), profiles["least"].to_numpy()
    for _, _, at, *own in sorted(found, key=lambda x: x[:2]):
        for members, pooled in groups:
            if not ends[at] and not ends[members[0]] and alike(pooled, own):
                break
        else:
            members, pooled = [], ({}, {})
            groups.append((members, pooled))
        members.append(at)
        for total, part in zip(pooled, own, strict=True):
            for key, count in part.items():
                total[key] = total.get(key, 0) + count * int(kinds[at])
    out = profiles[["host", "prefix", "ends", "profile"]].copy()
    for members, _ in groups:
        rows = out.index[members]
        out.loc[rows, "group"] = least[members[0]]
        out.loc[rows, "members"] = int(kinds[members].sum())
    return out.astype({"members": "int64"})


def templates(pages: DataFrame) -> DataFrame:
    """(host, segments, template, purity) of every distinct shaped path of ``pages`` (host, segments, ruled)."""
    counted = pages.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    tree = stored(counted.withColumn("prefix", F.lit("")), "paths")
    depth = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(depth):
        following = F.regexp_replace(F.get("segments", F.lit(level + 1)), r"^(?!\{[nhx]\}(\.[a-z]+)?$)[\s\S]+", "w")
        here = tree.withColumns(
            {
                "segment": F.coalesce(F.get("segments", F.lit(level)), F.lit("")),
                "next": F.coalesce(F.regexp_replace(following, r"\.[\s\S]*", ".*"), F.lit("")),
            }
        )
        sums = here.groupBy("host", "prefix", "segment", "next").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        entries = F.sort_array(F.collect_list(F.concat_ws(":", "next", "n", "labelled", "blocked")))  # a few kinds of next
        children = stored(sums.groupBy("host", "prefix", "segment").agg(F.array_join(entries, ",").alias("profile")).withColumn("ends", F.col("segment") == ""), "children")
        profiles = children.groupBy("host", "prefix", "ends", "profile").agg(F.count("*").alias("kinds"), F.min("segment").alias("least"))
        merged = stored(profiles.groupBy("host", "prefix").applyInPandas(merge, "host string, prefix string, ends boolean, profile string, group string, members long"), "merged")
        names = stored(children.join(merged, ["host", "prefix", "ends", "profile"]).select("host", "prefix", "segment", "group", "members"), "names")
        spelled = names.filter(f"members <= {BRANCHES}").groupBy("host", "prefix", "group").agg(F.array_join(F.sort_array(F.collect_list("segment")), "|").alias("spelled"))
        grown = F.coalesce("spelled", F.concat(F.lit("*("), "group", F.lit(")")))
        grown = F.when(F.col("segment") == "", F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), grown))
        joined = here.join(names, ["host", "prefix", "segment"]).join(stored(spelled, "spelled"), ["host", "prefix", "group"], "left")
        tree = stored(joined.select("host", "segments", "n", "labelled", "blocked", grown.alias("prefix")), "tree")
    purity = tree.groupBy("host", "prefix").agg(((F.sum("blocked") + WEIGHT * PRIOR) / (F.sum("labelled") + WEIGHT)).alias("purity"))
    return tree.select("host", "segments", "prefix").join(stored(purity, "purity"), ["host", "prefix"]).select("host", "segments", F.col("prefix").alias("template"), "purity")


def judge(pages: DataFrame, rules: list[Rule] = RULES, depth: int = DEPTH) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, template and purity. ``depth`` is that of :func:`shapes`."""
    host, path = host_and_path(F.col("url"))
    parsed = ruled(pages.select("page_id", host.alias("host"), path.alias("path")), rules).withColumn("segments", shapes(F.col("path"), depth))
    known = stored(templates(parsed), "templates")
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return parsed.join(known, ["host", "segments"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
