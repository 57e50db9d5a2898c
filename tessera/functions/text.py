"""Text expressions: all native, so they stay in generated code and can be pushed next to the scan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.schemas import choice

TOKEN = r"[\p{L}\p{N}]+"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
PULL_REQUEST = r"(?i)github\.com/[^/]+/([^/]+)/pull/(\d+)"
TICKET = r"\b([A-Z][A-Z0-9]+-\d+)\b"
# Languages of file extensions; any other is the extension itself.
LANGUAGES = {
    ".py": "python",
    ".java": "java",
    ".ts": "typescript",
    ".js": "javascript",
    ".md": "markdown",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".sh": "shell",
    ".json": "json",
}
# Folders and names of decision and architecture documents.
DECISION_FOLDERS = r"(?i)(^|/)(adr|adrs|decisions|rfcs|proposals|docs/adr|architecture)(/|$)"
DESIGN_STEMS = r"(?i)(architecture|lld|hld|design[_-]doc|adr-|rfc[_-]|decisions)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def squeezed(text: Column) -> Column:
    """Stripped, white space runs as one space, lower case; null as empty."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " "))


def fingerprint(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(squeezed(title), F.lit("\n\n"), squeezed(content)), 256)


def cache_key(*parts: Column) -> Column:
    """Digest of everything that decides a response."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def sorted_roles(roles: Column) -> Column:
    return F.array_join(F.array_sort(roles), ",")


def plain_name(name: Column) -> Column:
    """Latin accents dropped, lower case, everything but letters and digits as single spaces."""
    bare = F.regexp_replace(F.lower(F.translate(name, ACCENTED, PLAIN)), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(plain_name(name), " ", "-"), 1, 60)


#: Tokens of HTML: comments, scripts and styles with all they hold, tags with quoted attributes, declarations, text, a lone bracket.
_ATTRIBUTES = r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>"""
HTML_TOKEN = rf"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b{_ATTRIBUTES}.*?(?:</\1\s*>|\z)|</?[a-z]{_ATTRIBUTES}|<[!?][^>]*>|(?:[^<]++|<(?![a-z/!?]))++|<"""
HTML_TAG = r"^<[a-zA-Z/!?][\s\S]"
# Entities and what they stand for; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def _outside_macros(tokens: Column) -> Column:
    """The tokens that no macro holds. Macros nest: only their own tags are gone through in order, and what the outermost span goes."""
    opens = lambda t: t.rlike(r"(?i)^<ac:structured-macro\b") & ~t.endswith("/>")
    closes = lambda t: t.rlike(r"(?i)^</ac:structured-macro\b")
    marked = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), F.when(opens(t), 1).when(closes(t), -1).otherwise(0).alias("step")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("since"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(s: Column, m: Column) -> Column:
        depth = F.greatest(s["depth"] + m["step"], F.lit(0))
        ends = (s["depth"] > 0) & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(s["depth"] == 0, m["at"]).otherwise(s["since"]).alias("since"),
            F.when(ends, F.array_append(s["spans"], F.struct(s["since"].alias("first"), m["at"].alias("last")))).otherwise(s["spans"]).alias("spans"),
        )

    open_end = lambda s: F.when(s["depth"] > 0, F.array_append(s["spans"], F.struct(s["since"].alias("first"), F.lit(2**31 - 1).alias("last")))).otherwise(s["spans"])
    spans = F.aggregate(F.filter(marked, lambda m: m["step"] != 0), start, step, open_end)
    kept = F.transform(F.array(spans), lambda own: F.filter(tokens, lambda t, i: ~F.exists(own, lambda x: i.between(x["first"], x["last"]))))[0]  # bound: made once
    return F.when(F.exists(tokens, opens), kept).otherwise(tokens)


def html_to_text(html: Column) -> Column:
    """Visible text, a line for each run between tags; comments, scripts, styles and macros, however nested, go."""
    tokens = F.regexp_extract_all(html, F.lit(HTML_TOKEN), F.lit(0))

    def plain(t: Column) -> Column:
        for entity, char in ENTITIES.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return F.regexp_replace(t, r"^\s+|\s+$", "")

    texts = lambda own: F.transform(F.filter(_outside_macros(own), lambda t: ~t.rlike(HTML_TAG)), plain)
    return F.array_join(F.filter(F.transform(F.array(tokens), texts)[0], lambda t: t != ""), "\n")  # tokens are bound, so they are made once


def url_parts(url: Column) -> dict[str, Column]:
    return {"host": F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1), "path": F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)}


def embedding_text(title: Column, content: Column, limit: int = 750_000) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(content, F.lit("")), 1, limit))


def reason(message: Column) -> Column:
    return F.substring(message, 1, 256)


def image_version(image: Column, default: str = "unknown") -> Column:
    """What follows the last colon."""
    return F.when(F.instr(image, ":") > 0, F.element_at(F.split(image, ":"), -1)).otherwise(F.lit(default))


def doc_type(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.when(path.rlike(DECISION_FOLDERS), "adr").when(stem.rlike(DESIGN_STEMS), "architecture")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(ext: Column) -> Column:
    return F.coalesce(choice(ext, LANGUAGES, None), F.regexp_replace(ext, r"^\.+", ""))


def pull_request(url: Column) -> Column:
    """repo#number of a pull-request url, else null."""
    return F.when(url.rlike(PULL_REQUEST), F.concat(F.regexp_extract(url, PULL_REQUEST, 1), F.lit("#"), F.regexp_extract(url, PULL_REQUEST, 2)))


def tickets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TICKET), F.lit(1)))


def relation(label: Column) -> Column:
    return F.when(F.lower(label).rlike("fix|resolv|clos"), "fixed_by").otherwise("linked_to")


def log_line(ts: Column, level: Column, pod: Column, message: Column) -> Column:
    return F.concat_ws(" ", F.substring(ts.cast("string"), 1, 23), F.concat(F.lit("["), F.coalesce(level, F.lit("")), F.lit("]")), pod, message)


@F.pandas_udf(StringType())
def rich_text(trees: pd.Series) -> pd.Series:
    """Plain text of a rich-document tree in JSON; a tree that is no JSON object gives an empty text."""
    return trees.map(tree_text)


#: Kinds of nodes that end a line, of lists, and of breaks.
_LINES, _LISTS, _BREAKS = {"paragraph", "heading", "blockquote", "listItem"}, {"bulletList", "orderedList"}, {"hardBreak", "rule"}
#: Where a table cell begins and ends: its text is stripped.
_BEGIN, _END = object(), object()


def _listed(node: object) -> list[dict | None]:
    """The nodes below a node; None for what is none."""
    found = node.get("content") if isinstance(node, dict) else None
    return [c if isinstance(c, dict) else None for c in found] if isinstance(found, list) else []


def _own_text(node: object) -> str:
    found = node.get("text") if isinstance(node, dict) else None
    return found if isinstance(found, str) else ""


def _parts(node: dict) -> list:
    """What a node is made of, from left to right: texts, marks and nodes still to be opened."""
    kind, children = node.get("type"), _listed(node)
    if kind == "text":
        return [_own_text(node)]
    if kind in _BREAKS:
        return ["\n"]
    if kind in _LISTS:
        return [part for child in children for part in ("• ", child)]
    if kind == "codeBlock":
        return ["\n```\n", *map(_own_text, children), "\n```\n"]
    if kind == "table":
        cells = ((number, place, cell) for number, row in enumerate(children) for place, cell in enumerate([None, *_listed(row)]))
        return [part for number, place, cell in cells for part in (("\n" if number else "",) if not place else (" | " if place > 1 else "", _BEGIN, cell, _END))] + ["\n"]
    return [*children, "\n"] if kind in _LINES else children


def tree_text(tree: str | None) -> str:
    """The text of one tree, walked with a stack, so that no depth is too deep."""
    try:
        todo, out, cells = [json.loads(tree) if tree else None], [], []
    except (ValueError, RecursionError):
        return ""
    while todo:
        part = todo.pop()
        if part is _BEGIN:
            cells.append(len(out))
        elif part is _END:
            begin = cells.pop()
            out[begin:] = ["".join(out[begin:]).strip()]
        elif isinstance(part, str):
            out.append(part)
        elif isinstance(part, dict):
            todo += reversed(_parts(part))
    return "".join(out)
