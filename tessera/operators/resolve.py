"""Which customer a question means: every phrase of one to four words against the registry, banded by confidence.

Questions with their phrases, and the registry, are dealt into blocks; within one, the score of every phrase with every customer is bounded
by their longest common subsequence, made for all phrases at once, and a question's pairs are compared from the highest bound down until no other
can bring a customer among its three best, or reach ``LOW``.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import jaccard, windows
from tessera.functions.text import plain_name
from tessera.session import spread
from tessera.sources.scratch import stored

HIGH, MEDIUM, LOW = 0.80, 0.55, 0.30
CANDIDATES, DIGITS = 3, 6
#: About how many customers, and how many phrases, one block holds; a question stays whole.
BLOCK_ROWS, PHRASE_ROWS = 2_000, 20_000
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}  # all that a plain name holds
_PAD = len(_LETTERS)
_CODES = np.full(256, _PAD, np.uint8)
_CODES[[ord(c) for c in _LETTERS]] = list(_LETTERS.values())
#: Bounds that one array holds, and pairs that a question compares before it looks which others are worth it.
_BOUNDS, _FIRST = 1 << 21, 32


def _phrases() -> Column:
    """An array of (phrase, is_hint) of a question."""
    own = F.transform(F.array_distinct(windows(F.col("question"))), lambda p: F.struct(p.alias("phrase"), F.lit(False).alias("is_hint")))
    hint = F.when(F.coalesce(plain_name(F.col("hint")), F.lit("")) != "", F.array(F.struct(F.col("hint").alias("phrase"), F.lit(True).alias("is_hint")))).otherwise(F.array_repeat(F.struct(F.lit("").alias("phrase"), F.lit(True).alias("is_hint")), 0))
    return F.concat(hint, own)


def phrases(questions: DataFrame) -> DataFrame:
    """(question_id, phrase, is_hint): windows of the question and its hint, if it has one."""
    return questions.select("question_id", F.inline(_phrases()))


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each letter stands in each name, and the names' lengths."""
    counts = np.zeros((len(names), len(_LETTERS)), np.int32)
    for row, name in enumerate(names):
        for c in name:
            counts[row, _LETTERS[c]] += 1
    return counts, counts.sum(1)


#: Names up to this length have the places of their letters in one number.
_SHORT = 63


def _places(names: list[str]) -> np.ndarray:
    """For each letter and name, a bit for each place where the letter stands in the name; none for the filling after a phrase."""
    masks = np.zeros((len(_LETTERS) + 1, len(names)), np.uint64)
    for column, name in enumerate(names):
        for place, c in enumerate(name[:_SHORT]):
            masks[_LETTERS[c], column] |= np.uint64(1 << place)
    return masks


def _common(masks: np.ndarray, phrases: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each phrase with each short name: no matching blocks hold more letters."""
    sizes = np.array([len(p) for p in phrases])
    order = np.argsort(-sizes, kind="stable")  # the longest first, so that those with a letter at a place are the first ones
    codes = _CODES[np.array([phrases[i] for i in order], f"S{max(sizes.max(), 1)}").view(np.uint8).reshape(len(phrases), -1)]
    row = np.full((len(phrases), masks.shape[1]), (1 << 64) - 1, np.uint64)
    for place in range(sizes.max()):
        now = row[: np.searchsorted(-sizes[order], -place)]
        own = now & masks[codes[: len(now), place]]
        now[:] = (now + own) | (now - own)
    out = np.empty(row.shape, np.int64)
    out[order] = np.bitwise_count(~row)
    return out


class _Best:
    """The best customers of one question so far, each with its best phrase."""

    def __init__(self) -> None:
        self.found: dict[int, tuple[float, bool, str]] = {}
        self.least = LOW - 10.0**-DIGITS  # what a score must reach to matter

    def offer(self, at: int, score: float, is_hint: bool, phrase: str) -> None:
        if score < self.least or (at in self.found and self.found[at] >= (score, is_hint, phrase)):
            return
        self.found[at] = (score, is_hint, phrase)
        if len(self.found) >= CANDIDATES:
            least = heapq.nlargest(CANDIDATES, (s for s, _, _ in self.found.values()))[-1] - 10.0**-DIGITS
            if least > self.least:
                self.least = least
                self.found = {k: v for k, v in self.found.items() if v[0] >= least}


class _Block:
    """A block of the registry: exact scores of phrases with the customers that may be among a question's best."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows, self.owners = rows, defaultdict(list)
        self.aliases, self.words = defaultdict(set), defaultdict(set)
        for at, row in enumerate(rows):
            for alias in row["own_aliases"]:
                self.aliases[alias].add(at)
            for name in {row["own_id"], row["own_name"]}:
                self.owners[name].append(at)
                for word in name.split():
                    self.words[word].add(at)
        self.names = list(self.owners)
        self.sets = [[set(r["own_id"].split()), set(r["own_name"].split())] for r in rows]
        self.counts, self.sizes = _letters(self.names)
        self.places = _places(self.names)
        self.long = np.flatnonzero(self.sizes > _SHORT)
        self.matchers: dict[int, SequenceMatcher] = {}

    def ratio(self, phrase: str, name: int) -> float:
        if name not in self.matchers:
            self.matchers[name] = SequenceMatcher(None, "", self.names[name])
        self.matchers[name].set_seq1(phrase)
        return self.matchers[name].ratio()

    def bounds(self, phrases: list[str]) -> np.ndarray:
        """What the matching-blocks ratio of each phrase with each name cannot exceed: twice the common subsequence,
        or for long names the shared letters, over all letters."""
        shared = _common(self.places, phrases)
        if len(self.long):
            own = _letters(phrases)[0]
            for name in self.long:
                shared[:, name] = np.minimum(own, self.counts[name]).sum(1)
        return 2 * shared / (np.array([len(p) for p in phrases])[:, None] + self.sizes)

    def sure(self, phrase: str) -> list[tuple[int, float]]:
        """(row, score) by alias and by shared words."""
        own = phrase.split()
        out = [(at, 1.0) for at in self.aliases.get(phrase, ())]
        if any(w in self.words for w in own):
            own = set(own)
            out += [(at, max(len(own & other) / len(own | other) for other in self.sets[at])) for at in set().union(*(self.words.get(w, ()) for w in own))]
        return out

    def compare(self, best: _Best, phrases: list[tuple[str, str, bool]], bounds: np.ndarray) -> None:
        """Take the pairs of some phrases (phrase, plain, is_hint) of a question, by their bounds, into its best."""
        flat = bounds.ravel()

        def take(some: np.ndarray) -> None:
            for pair in some[np.argsort(-flat[some], kind="stable")]:
                if flat[pair] < best.least:
                    return
                at, name = divmod(int(pair), len(self.names))
                phrase, plain, is_hint = phrases[at]
                score = self.ratio(plain, name)
                for owner in self.owners[self.names[name]]:
                    best.offer(owner, score, is_hint, phrase)

        first = np.argpartition(-flat, _FIRST)[:_FIRST] if len(flat) > _FIRST else np.arange(len(flat))
        take(first)
        if len(first) < len(flat):
            worth = flat >= best.least
            worth[first] = False
            take(np.flatnonzero(worth))


def _best_of_block(asked: pa.Table, registry: pa.Table) -> pa.Table:
    block = _Block(registry.to_pylist())
    best = [_Best() for _ in range(len(asked))]
    every = ((number, (p["phrase"], p["phrase"] if p["plain"] is None else p["plain"], p["is_hint"])) for number, own in enumerate(asked.column("phrases")) for p in own.as_py() or ())
    for some in iter(lambda: list(itertools.islice(every, max(1, _BOUNDS // max(1, len(block.names))))), []) if block.names else ():
        index: dict[str, int] = {}
        for _, (_, plain, _) in some:
            index.setdefault(plain, len(index))
        bounds, sure = block.bounds(list(index)), [block.sure(plain) for plain in index]
        for number, pairs in itertools.groupby(some, lambda x: x[0]):
            own = [p for _, p in pairs]
            for phrase, plain, is_hint in own:
                for at, score in sure[index[plain]]:
                    best[number].offer(at, score, is_hint, phrase)
            block.compare(best[number], own, bounds[[index[plain] for _, plain, _ in own]])
    out = [(number, block.rows[at], *found) for number, own in enumerate(best) for at, found in own.found.items()]
    columns = [[r["customer_id"] for _, r, *_ in out], [r["name"] for _, r, *_ in out], [r["position"] for _, r, *_ in out], *([x[i] for x in out] for i in (2, 3, 4))]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]
    ids = asked.column("question_id").take(pa.array([x[0] for x in out], pa.int64()))
    return pa.table([ids, *map(pa.array, columns, kinds)], names=["question_id", "customer_id", "name", "position", "score", "is_hint", "phrase"])


def scored(questions: DataFrame, customers: DataFrame) -> DataFrame:
    """(question_id, customer_id, name, position, score, phrase): the customers that may be a question's best, each with its
    best phrase; a hint wins ties. Customers whose best phrase scores under ``LOW`` are left out."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    registry = customers.select(
        F.col("id").alias("customer_id"), "name", F.col("position").cast("long").alias("position"), F.coalesce(plain_name(F.replace("id", F.lit("-"), F.lit(" "))), F.lit("")).alias("own_id"),
        F.coalesce(plain_name(F.col("name")), F.lit("")).alias("own_name"), F.transform(F.filter(aliases, lambda a: a.isNotNull()), lambda a: plain_name(a)).alias("own_aliases"),
    ).filter("customer_id IS NOT NULL")
    held = F.transform(_phrases(), lambda p: F.struct(p["phrase"].alias("phrase"), F.when(p["is_hint"], plain_name(p["phrase"])).alias("plain"), p["is_hint"].alias("is_hint")))  # windows are plain already
    named = stored(spread(questions).select("question_id", held.alias("phrases")).filter(F.size("phrases") > 0), "phrases")  # made once, read for their number and the comparison
    blocks, parts = max(1, -(-registry.count() // BLOCK_ROWS)), max(1, -(-(named.agg(F.sum(F.size("phrases"))).first()[0] or 0) // PHRASE_ROWS))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = named.withColumn("part", F.pmod(F.xxhash64("question_id"), F.lit(parts)).cast("int")).withColumn("block", number(blocks))
    right = registry.withColumn("block", F.pmod(F.xxhash64("customer_id", "name", "position"), F.lit(blocks)).cast("int")).withColumn("part", number(parts))
    kind = questions.schema["question_id"].dataType.simpleString()
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_best_of_block, f"question_id {kind}, customer_id string, name string, position long, score double, is_hint boolean, phrase string")
    best = F.max(F.struct("score", "is_hint", "phrase")).alias("best")
    return found.groupBy("question_id", "customer_id", "name", "position").agg(best).select("question_id", "customer_id", "name", "position", "best.score", "best.phrase")


def resolved(questions: DataFrame, scores: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(question_id, decision, customer_id, confidence, candidates) of every question: bands of the best score; ties go to
    registry order. Without a customer of at least ``LOW`` it is unknown, with confidence 0."""
    rows = scores.withColumn("score", F.round("score", digits))
    rows = rows.withColumn("turn", F.expr("row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position, customer_id)")).filter(F.col("turn") <= CANDIDATES)
    order = F.struct((-F.col("score")).alias("worse"), "position", "customer_id", "score")
    ranked = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(order)).alias("ranked"))  # CANDIDATES at most
    ranked = questions.select("question_id").distinct().join(ranked, "question_id", "left")
    top = F.try_element_at("ranked", F.lit(1))
    score = F.coalesce(top["score"], F.lit(0.0))
    decision = F.when(score >= 1, "resolved").when(score >= HIGH, "resolved_confirm").when(score >= MEDIUM, "assumed_confirm").when(score >= LOW, "ask").otherwise("unknown")
    shown = F.transform(F.slice(F.filter("ranked", lambda r: r["score"] >= LOW), 1, CANDIDATES), lambda r: r["customer_id"])
    return ranked.select("question_id", decision.alias("decision"), F.when(score >= MEDIUM, top["customer_id"]).alias("customer_id"), score.alias("confidence"), F.when(decision == "ask", shown).alias("candidates"))


def token_matches(questions: DataFrame, customers: DataFrame, least: float = 0.3) -> DataFrame:
    """(question_id, customer_id, similarity) by shared words alone, without a cross product: words meet words first."""
    left = questions.withColumn("word", F.explode(F.array_distinct(F.split(plain_name(F.col("question")), " "))))
    right = customers.withColumn("word", F.explode(F.array_distinct(F.split(plain_name(F.col("name")), " "))))
    pairs = left.join(right.select("word", F.col("id").alias("customer_id"), "name"), "word").select("question_id", "question", "customer_id", "name").distinct()
    return pairs.withColumn("similarity", F.round(jaccard(plain_name(F.col("question")), plain_name(F.col("name"))), 6)).filter(F.col("similarity") >= least).select("question_id", "customer_id", "similarity")
