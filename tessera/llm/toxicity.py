"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Most windows of a toxic text are
ordinary, so the toxic dictionary is trained in rounds: the toxic texts are halved, a dictionary trained on the windows
of one half compresses those of the other, and only windows that it shortens by a length that is ``RATIO`` times as
frequent as among ordinary ones train the next round's. What only one text holds does not survive that, what toxic texts share does. The
ordinary dictionary is completed by the ordinary windows that the toxic one shortens most. The toxic compressor gets the
ordinary dictionary behind its own, so both price ordinary wording alike.

Every text is cut into windows of ``WINDOW`` words; its features are the three largest differences of compressed length
and the number of windows. A logistic curve, fitted on texts that trained neither dictionary, calibrates them to a
probability with its threshold at 0.5.

Null texts, empty texts and texts without letters have no window: their score is the curve at zero difference. Very long
texts are scored over all their windows. With no toxic or no ordinary labelled text every score is 0. Labels that are
null or belong to no document are ignored; a document with several labels counts as toxic if one says so. Of rows that
repeat a doc_id one trains; repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columnar import bound_batches, documents, text_slices
from tessera.llm.letters import class_sample, id_remainder, letters_only

#: Words of a window that is scored, and of one that trains.
WINDOW, TRAINING_WINDOW = 8, 2
ORDINARY_BYTES = 131_072
#: Most bytes of the toxic dictionary of a round; sizes of the last one, of which the best calibrated is taken.
ROUND_BYTES, TOXIC_BYTES, ROUNDS = 4096, (512, 1024, 2048, 4096), 3
#: Bytes of a segment of the trainer: the ordinary dictionary keeps passages, the toxic one what a window of training holds
#: at most, two words of eight characters in the spelling of :func:`windows`; longer ones bring ordinary wording along.
ORDINARY_SEGMENT, TOXIC_SEGMENT = 200, 32
#: How many times as often windows of toxic texts have to be shortened by so much as ordinary ones; how many of these are
#: looked at for it.
RATIO, COMPARED = 3.0, 40_000
#: Bytes of ordinary windows that complete the ordinary dictionary.
HARD_BYTES = 16_384
#: Differences beyond this tell no more.
MOST = 14
#: Odd, so that every byte pair keeps a code of its own in 16 bits.
PAIR_FACTOR = 0x9E37
#: Bound of the training sample, in rows of each class and in characters of each row; see :func:`fit`.
SAMPLE, MAX_CHARS = {0: 5000, 1: 2000}, 20_000
#: Passages, evenly spread over a longer text, that stand for it in the training sample.
PASSAGES = 20
#: Least hashed word triples by which copies among the sample are known.
TRIPLES = 12


def windows(text: str, words: int = WINDOW) -> list[bytes]:
    """The windows of a prepared text, spelled in overlapping byte pairs of two bytes each.

    The spelling doubles what a literal costs but not what a match costs, so a whole span that a dictionary knows
    outweighs the byte or two that lengths vary by chance.
    """
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return []
    pairs = ((data[:-1] << 8 | data[1:]) * np.uint32(PAIR_FACTOR)).astype("<u2").tobytes()
    cuts = [*(2 * np.flatnonzero(data[:-1] == 32)[::words]).tolist(), len(pairs)]
    return [pairs[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        8, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, min_match=6, window_log=18, search_log=6
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=parameters)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None  # of the features and 1

    def open(self) -> "ToxicityModel":
        """Compressors do not travel between processes: each builds its own."""
        if not hasattr(self, "_pair"):
            self._pair = compressor(self.ordinary).compress, compressor(self.toxic + self.ordinary).compress
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def features(self, text: str) -> list[float]:
        plain, toxic = self._pair
        gains = [len(plain(w)) - len(toxic(w)) for w in windows(text)]
        first = sorted(gains, reverse=True)[:3] + [0, 0, 0]
        return [*(float(min(max(g, 0), MOST)) for g in first[:3]), math.log1p(len(gains)), 1.0]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        self.open()
        x = np.array([self.features(t) for t in texts]).reshape(-1, 5)
        return 1 / (1 + np.exp(-(x @ self.weights)))


def without_copies(texts: list[str]) -> list[str]:
    """The texts without copies and near copies of an earlier kept one.

    A text goes if at least half of its ``TRIPLES`` least hashed word triples are those of one kept text; one shared
    passage, or passages shared with different texts, do not make a copy.
    """
    holders: dict[tuple[int, int], list[int]] = {}
    kept: list[str] = []
    for text in texts:
        words = text.split()
        triples = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint32)
        keys = [(k, int((triples * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32))).min())) for k in range(TRIPLES)]
        shared = Counter(i for key in keys for i in holders.get(key, ()))
        if 2 * max(shared.values(), default=0) < TRIPLES:
            for key in keys:
                holders.setdefault(key, []).append(len(kept))
            kept.append(text)
    return kept


def trained_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary that zstandard's trainer makes of the samples."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: they serve themselves
        return b"".join(sorted(set(samples)))[-size:]


def toxic_windows(toxic: list[str], ordinary: list[bytes], plain: bytes, rounds: int = ROUNDS) -> list[bytes]:
    """The windows of toxic texts that a dictionary trained on other toxic texts shortens as hardly any ordinary one."""
    halves = [[w for t in toxic[h::2] for w in windows(t, TRAINING_WINDOW)] for h in (0, 1)]
    price = compressor(plain).compress
    costs = [np.array([len(price(w)) for w in own]) for own in (*halves, ordinary)]
    chosen = halves
    for _ in range(rounds):
        found = []
        for h in (0, 1):
            size = min(ROUND_BYTES, max(1024, sum(map(len, halves[1 - h])) // 50))
            own = compressor(trained_dictionary(chosen[1 - h], size, TOXIC_SEGMENT) + plain).compress
            gains = [cost - np.array([len(own(w)) for w in group]) for cost, group in ((costs[h], halves[h]), (costs[2], ordinary))]
            inside, outside = (np.array([(g >= least).mean() if len(g) else 0.0 for least in range(1, MOST + 1)]) for g in gains)
            telling = np.flatnonzero(inside >= RATIO * outside)
            found.append([halves[h][k] for k in np.flatnonzero(gains[0] >= (telling[0] + 1 if len(telling) else MOST))])
        if min(map(len, found)) < 8:
            break
        chosen = found
    return chosen[0] + chosen[1]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the features: differences may only speak for a toxic text and their number only against it."""
    sign = np.array([1, 1, 1, -1, 0])
    used = np.arange(len(sign))
    while True:
        w = logistic(x[:, used], y)
        if not len(wrong := np.flatnonzero(w * sign[used] < 0)):
            out = np.zeros(len(sign))
            out[used] = w
            return out
        used = np.delete(used, wrong)


def train(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Fit on prepared texts; each third text calibrates and trains no dictionary."""
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", None)
    split = [([t for i, t in enumerate(texts) if i % 3 or len(texts) < 12], texts[::3]) for texts in (without_copies(sorted(toxic)), without_copies(sorted(ordinary)))]
    (fit1, held1), (fit0, held0) = split
    samples = [w for t in fit0 for w in windows(t)]
    plain = trained_dictionary(samples, min(ORDINARY_BYTES, max(1024, sum(map(len, samples)) // 10)), ORDINARY_SEGMENT)
    short = [w for t in fit0 for w in windows(t, TRAINING_WINDOW)]
    order = np.random.default_rng(1).permutation(len(short))
    compared, others = [short[i] for i in order[:COMPARED]], [short[i] for i in order[COMPARED : 3 * COMPARED]]
    chosen = toxic_windows(fit1, compared, plain)
    target = np.array([1.0] * len(held1) + [0.0] * len(held0))
    one, best = compressor(plain).compress, (math.inf, ToxicityModel(b"", b"", None))
    before = np.array([len(one(w)) for w in others])
    for size in TOXIC_BYTES:
        found = trained_dictionary(chosen, size, TOXIC_SEGMENT)
        two = compressor(found + plain).compress
        gains = before - np.array([len(two(w)) for w in others], np.int64)
        hard = {others[k] for k in np.flatnonzero(gains >= max(4.0, float(np.quantile(gains, 0.998))))} if len(others) else set()
        model = ToxicityModel(b"".join(sorted(hard))[-HARD_BYTES:] + plain, found, np.zeros(5)).open()
        x = np.array([model.features(t) for t in held1 + held0])
        model.weights = calibrate(x, target)
        loss = float(np.logaddexp(0, np.where(target == 1, -1, 1) * (x @ model.weights)).mean())
        best = min(best, (loss, model), key=lambda b: b[0])
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Train on about ``sample`` labelled rows of each class.

    A row brings ``max_chars`` characters to the driver at most: a longer text is represented by ``PASSAGES`` passages
    spread evenly over it. Only ids, bounded by the sample, are broadcast. Scoring has neither bound.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    drawn = class_sample(known, "toxic", sample).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", letters_only(F.col("text")).alias("text"))
    passage = max_chars // PASSAGES
    spread = F.expr(f"concat_ws(' ', transform(sequence(0, {PASSAGES - 1}), i -> substring(text, cast(1 + i * floor(length(text) / {PASSAGES}) AS int), {passage})))")
    short = rows.withColumn("text", F.when(F.length("text") <= max_chars, F.col("text")).otherwise(F.concat(F.lit(" "), spread, F.lit(" "))))
    found = short.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).filter("text <> ''").collect()
    return train([r["text"] for r in found if r["toxic"]], [r["text"] for r in found if not r["toxic"]])


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) of every row with ``score`` and ``predicted``."""
    keep = keep or ["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "__letters"):
                s = model.score(texts)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep)] + ["score double, predicted int"])
    return docs.select(*keep, letters_only(F.col("text")).alias("__letters")).mapInArrow(run, schema)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``; labels are learned from rows outside the held-out fold.

    A row without doc_id has no fold: it is not held out, and has no label to learn.
    """
    docs = documents(spark, sf_dir)
    return score(docs, trained(spark, docs, sf_dir)).select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the others go.

    Null and empty texts have no window and stay. Repeated rows stay or go together; extra columns stay, whatever their
    names; an empty table gives an empty one. Without toxic or ordinary labels every document stays.
    """
    bound_batches(spark)
    rows = docs.select(F.struct("*").alias("row"), "text")  # whatever the columns are called, they do not meet the results
    return score(rows, trained(spark, docs, sf_dir), ["row"]).filter("predicted = 0").select("row.*")
