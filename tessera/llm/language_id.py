"""Language identification by averaged hashed subword embeddings.

Every byte n-gram of three and four bytes inside a word (its boundaries count as a byte) is hashed to one of
``buckets`` embeddings; a text is the average of its embeddings, and a linear softmax over that average gives the
language. Both layers are trained together by stochastic gradient descent in numpy on about ``sample`` labelled rows a
language. A held-out fifth of that sample calibrates the softmax temperature and the confidence under which a text is
rejected. As both layers are linear, prediction folds them into one table of bucket scores.

A null text and a text without letters get ``und`` with score 0. Without any labelled row every text gets ``und``. Very
long texts train and are predicted whole. Of rows that repeat a doc_id one trains; repeated rows get equal results, extra
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columnar import bound_batches, documents, text_slices
from tessera.llm.letters import bounded, class_sample, id_remainder, letters_only

UNDETERMINED = "und"


def subwords(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, one after another, and where each text's begin (one bound more than texts)."""
    blobs = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    data = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.cumsum(sizes)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    b = data.astype(np.uint32)
    inner = data != 32
    three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    four = three[:-1] * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
    last = np.repeat(ends, sizes)  # a gram must end within its own text
    at = np.arange(len(data))
    keep3 = inner[1:-1] & (at[:-2] + 3 <= last[:-2])
    keep4 = inner[1:-2] & inner[2:-1] & (at[:-3] + 4 <= last[:-3])
    place = np.concatenate([at[:-2][keep3], at[:-3][keep4]])
    grams = np.concatenate([three[keep3], four[keep4]])
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    order = np.argsort(np.searchsorted(ends, place, "right"), kind="stable")
    bounds = np.searchsorted(np.searchsorted(ends, place[order], "right"), np.arange(len(texts) + 1))
    return (grams[order] >> np.uint32(32 - bits)).astype(np.int64), bounds


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def bucket_counts(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text with how often they occur in it."""
    found: list = [None] * len(texts)
    for owners, parts in bounded(texts):
        buckets, bounds = subwords(parts, bits)
        for owner, a, b in zip(owners, bounds[:-1], bounds[1:], strict=True):
            own = np.unique(buckets[a:b], return_counts=True)
            if found[owner] is not None:  # another piece of the same text
                both = np.bincount(np.concatenate([found[owner][0], own[0]]), np.concatenate([found[owner][1], own[1]]), 1 << bits).astype(np.int64)
                own = np.flatnonzero(both), both[both > 0]
            found[owner] = own
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: embeddings times the softmax layer
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated confidence of texts that :func:`letters_only` has prepared."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for owners, parts in bounded(texts):
            buckets, bounds = subwords(parts, self.bits)
            np.add.at(sums, owners, segment_sums(self.scores[buckets], bounds))
            np.add.at(n, owners, np.diff(bounds))
        logits = sums / np.maximum(n, 1)[:, None] + self.bias
        logits /= self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lettered = np.fromiter((t != "" for t in texts), bool, len(texts))
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)], np.where(lettered, p[np.arange(len(best)), best], 0.0)


def train(counts: list[tuple[str, np.ndarray, np.ndarray]], bits: int = 14, width: int = 16, epochs: int = 8, batch: int = 64, rate: float = 20.0, seed: int = 7) -> LanguageModel:
    """Fit on rows of (language, buckets, counts)."""
    languages = sorted({language for language, _, _ in counts})
    size = 1 << bits
    if not languages:
        return LanguageModel([], np.zeros((size, 0)), np.zeros(0), 1.0, 0.0, bits)
    target = np.array([languages.index(language) for language, _, _ in counts])

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), size), np.float32)
        for k, row in enumerate(rows):
            x[k, counts[row][1]] = counts[row][2] / max(counts[row][2].sum(), 1)
        return x

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts))
    held, fitted = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 20 else (order, order)
    embedding = rng.normal(0, 0.1, (size, width)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    share = np.bincount(target[fitted], minlength=len(languages)).astype(np.float32)
    weight = len(fitted) / (len(languages) * np.maximum(share, 1))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fitted), batch):
            rows = rng.permutation(fitted)[:batch] if len(fitted) < batch else fitted[at : at + batch]
            x = dense(rows)
            hidden = x @ embedding
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p *= weight[target[rows]][:, None] / len(rows)
            back = p @ layer.T
            layer -= step * 0.05 * (hidden.T @ p)
            bias -= step * 0.005 * p.sum(axis=0)
            embedding -= step * (x.T @ back)
        rng.shuffle(fitted)
    scores = embedding.astype(np.float64) @ layer
    z = np.concatenate([dense(held[i : i + 256]) @ scores + bias for i in range(0, len(held), 256)])

    def confidence(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(confidence(t)[np.arange(len(held)), target[held]], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = confidence(temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == target[held]]
    reject_below = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return LanguageModel(languages, scores.astype(np.float32), bias.astype(np.float64), temperature, reject_below, bits)


def fit(docs: DataFrame, sample: int = 1000, bits: int = 14) -> LanguageModel:
    """Train on about ``sample`` rows of each language among ``docs`` (lang and text not null), whole texts of any length.

    What is collected of a row is bounded by the buckets, not by its text.
    """
    rows = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    drawn = class_sample(rows, "lang", sample)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                found = bucket_counts(texts, bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([k.astype("<u2").tobytes() for k, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                    ["lang", "buckets", "counts"],
                )

    found = drawn.select("lang", letters_only(F.col("text")).alias("text")).filter("text <> ''").mapInArrow(count, "lang string, buckets binary, counts binary").collect()
    return train(sorted(((r["lang"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<u4")) for r in found), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())), bits)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) of every row with ``lang_pred``, ``score`` and ``rejected``.

    ``rejected`` holds where the text has no letters or its confidence is under the calibrated bound.
    """
    keep = keep or ["doc_id"]
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "__letters"):
                language, score = model.predict(texts)
                rejected = [k == UNDETERMINED or s < model.reject_below for k, s in zip(language, score, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(language, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string, score double, rejected boolean"])
    return docs.select(*keep, letters_only(F.col("text")).alias("__letters")).mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``; learned from rows outside the held-out fold.

    A row without doc_id has no fold: it is not held out and trains nothing.
    """
    docs = documents(spark, sf_dir)
    fold = id_remainder(F.col("doc_id"), 4)
    model = fit(docs.filter(fold != 2))
    return identify(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go.

    Null, empty and letterless texts are not recognised. Repeated rows stay or go together; extra columns stay, whatever
    their names; an empty table gives an empty one. Without any labelled row nothing is recognised.
    """
    bound_batches(spark)
    model = fit(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    rows = docs.select(F.struct("*").alias("row"), "text")  # whatever the columns are called, they do not meet the results
    return identify(rows, model, ["row"]).filter("NOT rejected").select("row.*")
