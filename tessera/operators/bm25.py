"""BM25 over any text column: term statistics, scores, fuzzy terms, recency decay, highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN, tokens
from tessera.session import spread

K1, B = 1.2, 0.75
DECAY_SCALE_MS, DECAY = 2_592_000_000, 0.5
FUZZY_EXPANSIONS = 50


def _word(term: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"


def counted(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, tf): words of each text and how often each term stands in it. One pass for words, one for terms; no word leaves the scan.

    The result is dealt by key so that what reads it twice (figures and scores) shares one exchange of a few bytes a text.
    """
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    if terms:
        hits = F.regexp_extract_all(lower, F.lit(_word("(" + "|".join(map(re.escape, terms)) + ")")), F.lit(1))
        tf = F.transform(F.array(hits), lambda own: F.array(*(F.size(F.filter(own, _is(w))) for w in terms)))[0]  # bound, so that the texts are read once
    else:
        tf = F.array().cast("array<int>")
    return spread(docs.select(key, text)).select(F.col(key), F.regexp_count(lower, F.lit(TOKEN)).alias("dl"), tf.alias("tf")).repartition(F.col(key))


def _is(term: str):
    return lambda t: t == term


def figures(counts: DataFrame, n_terms: int) -> DataFrame:
    """One row: n, avgdl and the document frequency of each term."""
    df = F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(n_terms))) if n_terms else F.array().cast("array<long>")
    return counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), df.alias("df"))


def corpus_figures(docs: DataFrame, query_terms: list[str], text: str = "text") -> DataFrame:
    """(term, df, n, avgdl) of the terms that occur."""
    terms = sorted(set(query_terms))
    row = figures(counted(docs, terms, docs.columns[0], text), len(terms))
    named = F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.col("df").alias("df"))
    return row.select(F.explode(named).alias("t"), "n", "avgdl").select(F.col("t")["term"].alias("term"), F.col("t")["df"].alias("df"), "n", "avgdl").filter("df > 0")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _score(weights: Column, tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    """Sum over the terms; all arrays have one entry a term."""
    share = lambda t: t / (t + K1 * (1 - B + B * dl / avgdl))
    part = lambda x: x["w"] * idf(n, x["df"]) * share(x["tf"])
    return F.aggregate(F.arrays_zip(weights.alias("w"), tf.alias("tf"), df.alias("df")), F.lit(0.0), lambda s, x: s + part(x))


def scores(docs: DataFrame, query_terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of the documents that hold a query term; a term named twice counts twice."""
    terms = sorted(set(query_terms))
    counts = counted(docs, terms, key, text)
    weights = F.array(*(F.lit(float(query_terms.count(t))) for t in terms)) if terms else F.array().cast("array<double>")
    rows = counts.crossJoin(F.broadcast(figures(counts, len(terms))))  # one row of figures
    return rows.select(key, _score(weights, F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")).alias("score")).filter("score > 0")


def edits(term: str) -> int:
    """Edits that automatic fuzziness allows a term of this length."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def swaps(word: Column) -> Column:
    """The word with each two neighbouring letters exchanged."""
    places = F.when(F.length(word) > 1, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))))


def distance(a: Column, b: Column) -> Column:
    """Edits between two words, where exchanging neighbours is one; exact up to two edits, never less than the true distance."""
    least = lambda own, other: F.coalesce(F.array_min(F.transform(swaps(own), lambda s: F.levenshtein(s, other))) + 1, F.lit(99))
    return F.least(F.levenshtein(a, b), least(a, b), least(b, a), F.when(F.arrays_overlap(swaps(a), swaps(b)), 2).otherwise(99))


def nearest_terms(vocabulary: DataFrame, query_terms: list[str]) -> DataFrame:
    """(query_term, term, distance): words of a vocabulary (term, df) near each query term, the nearest ``FUZZY_EXPANSIONS`` of each."""
    wanted = F.array(*(F.struct(F.lit(t).alias("query_term"), F.lit(edits(t)).alias("k")) for t in sorted(set(query_terms))))
    near = vocabulary.select("term", "df", F.inline(F.filter(wanted, lambda w: F.abs(F.length("term") - F.length(w["query_term"])) <= w["k"])))
    close = near.filter("levenshtein(term, query_term, 2 * k) >= 0")  # an exchange is two plain edits
    found = close.withColumn("distance", distance(F.col("query_term"), F.col("term"))).filter("distance <= k")
    return found.withColumn("place", F.expr("row_number() OVER (PARTITION BY query_term ORDER BY distance, df DESC, term)")).filter(f"place <= {FUZZY_EXPANSIONS}").select("query_term", "term", "distance")


def expansions(docs: DataFrame, query_terms: list[str], text: str = "text") -> DataFrame:
    """(query_term, term, distance): vocabulary of the texts near each query term."""
    vocabulary = spread(docs.select(text)).select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return nearest_terms(vocabulary, query_terms)


def fuzzy_scores(docs: DataFrame, query_terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`scores`, where each near term of the vocabulary counts like the query term it is near to."""
    near = [r["term"] for r in expansions(docs, query_terms, text).select("term").collect()]  # at most FUZZY_EXPANSIONS a query term
    return scores(docs, near, key, text)


def decayed(score: Column, created_at: Column, as_of: Column) -> Column:
    """Halved at one scale of distance, as a Gaussian of the age."""
    age = F.abs(F.unix_millis(as_of) - F.unix_millis(created_at))
    return score * F.pow(F.lit(DECAY), F.pow(age / F.lit(float(DECAY_SCALE_MS)), F.lit(2.0)))


def highlights(text: Column, query_terms: list[str], size: int = 150, most: int = 2) -> Column:
    """The fragments with most hits, hits marked; an empty array without any."""
    terms = "|".join(re.escape(t) for t in sorted(query_terms, key=lambda t: (-len(t), t)))
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}])({terms})(?![\p{{L}}\p{{N}}])"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\S.{{0,{size - 1}}}(?=\s|$)|\S{{1,{size}}}"), F.lit(0))
    counted = F.transform(pieces, lambda p, i: F.struct((-F.regexp_count(p, F.lit(pattern))).alias("hits"), i.alias("place"), p.alias("piece")))
    best = F.slice(F.array_sort(F.filter(counted, lambda c: c["hits"] < 0)), 1, most)
    return F.transform(best, lambda c: F.regexp_replace(c["piece"], pattern, "<em>$1</em>"))


def all_terms(text: Column, query_terms: list[str]) -> Column:
    """Whether every term occurs."""
    return F.size(F.array_except(F.array(*map(F.lit, query_terms)), tokens(text))) == 0 if query_terms else F.lit(True)


def batch_scores(docs: DataFrame, questions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(question_id, key, score) of many questions (question_id, question) in one plan.

    Only words that some question has leave the scan, as counts; they meet the questions on the word, and a word's
    document frequency comes from the same counts. Hot words are left to adaptive skew handling.
    """
    wanted = questions.select("question_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("weight"))
    sized = spread(docs.select(key, text)).select(F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens"))
    counts = sized.select(key, "dl", F.explode("tokens").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    rows = counts.join(frequency, "term").join(wanted, "term").crossJoin(F.broadcast(sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))))  # one row
    part = F.col("weight") * idf(F.col("n"), F.col("df")) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("question_id", key).agg(F.sum(part).alias("score"))


def batch_top(scored: DataFrame, k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k best documents of each question; ranks are limited before the shuffle too."""
    rounded = scored.withColumn("score", F.round("score", digits))
    rank = F.expr(f"row_number() OVER (PARTITION BY question_id ORDER BY score DESC, `{key}`)")
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k)
