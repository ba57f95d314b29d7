"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives, and a sample of all training texts, labelled or not, is
the unlabelled set; the words it looks at are chosen by counts over all of them. The class prior is the share of toxic rows among the labelled training rows.
A linear model over the presence of selected words minimises the risk

    prior * R(P, +) + max(0, R(U, -) - prior * R(P, -))

with the logistic loss; where the bracket is negative, the step follows its negated gradient, so
that the model can't fit the positives hidden in the unlabelled set as negatives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.llm.storage import stash

POSITIVES = 4000
UNLABELLED = 16000
FEATURES = 600
CANDIDATES = 50_000
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
LEAST_POSITIVES = 3
STEPS = 400
RATE = 0.05
DECAY = 5e-4
LEAST_Z = 4.0
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> set[str]:
    return set(_TOKEN.findall(text.lower())) if text else set()


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def margin(self, text: str | None) -> float:
        found = tokens(text) & self.vocabulary.keys()
        return self.bias + float(sum(self.weights[self.vocabulary[w]] for w in sorted(found)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float, theta: np.ndarray, decay: float) -> np.ndarray:
    """The direction of a step uphill: that of the risk, or of its negated bracket where that is below zero."""

    def side(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = x @ theta[:-1].astype(x.dtype) + x.dtype.type(theta[-1])
        return margin, _sigmoid(margin)

    def mean(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(x.T @ slope, slope.sum()) / len(x)

    (gp, sp), (gu, su) = side(positive), side(unlabelled)
    negative = mean(unlabelled, su) - prior * mean(positive, sp)
    risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    return (prior * mean(positive, sp - 1) + negative if risk >= 0 else -negative) + decay * np.append(theta[:-1], 0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk."""
    theta = np.zeros(positive.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = gradient(positive, unlabelled, prior, theta, decay)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _counting(among: frozenset[str] | None) -> Callable:
    """How many texts hold each word, some words of a task at a time; only those in ``among``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text) if among is None else tokens(text) & among)
            if len(counts) > HELD_WORDS:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return run


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def train(docs: DataFrame, labels: DataFrame, learnable: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model | None:
    """Fit on at most ``positives`` toxic rows and, as the unlabelled set of the risk, about ``unlabelled`` rows of all.

    Both are chosen by a hash of doc_id. The words of the toxic rows that at least
    ``LEAST_POSITIVES`` of them hold are candidates, ``CANDIDATES`` at most; they are counted in
    all learnable texts, and the ``features`` whose share differs most become features.
    ``learnable`` is a condition on doc_id; no other rows' labels or texts are used. None if there
    is no toxic row to learn from.
    """
    marks = labels.where(learnable & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counted = marks.where(F.col("toxic").isNotNull()).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not counted["n"] or not counted["t"]:
        return None
    prior = min(0.9, max(1e-3, counted["t"] / counted["n"]))
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = marks.where("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit(31))).limit(positives).select("doc_id").collect()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in chosen], "doc_id long")
    texts = docs.where(learnable & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.count()
    p = texts.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("positive", F.lit(True))
    u = texts.where(draw(32) < min(1.0, unlabelled / max(1, total))).withColumn("positive", F.lit(False))
    sample = stash(p.unionByName(u), "toxicity-sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return None
    counts = lambda rows, among: rows.select("text").transform(map_batches, _counting(among), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    held = {r["word"]: r["n"] for r in counts(sample.where("positive"), None).where(F.col("n") >= LEAST_POSITIVES).orderBy(F.desc("n"), "word").limit(CANDIDATES).collect()}
    everywhere = {r["word"]: r["n"] for r in counts(texts, frozenset(held)).collect()}

    def apart(word: str) -> float:
        """By how many standard deviations the share among toxic rows differs from that of all."""
        rate_p, rate_u = (held[word] + 0.5) / (sizes[True] + 1), (everywhere.get(word, 0) + 0.5) / (total + 1)
        return abs(rate_p - rate_u) / np.sqrt(rate_u * (1 - rate_u) / sizes[True] + 1e-12)

    best = sorted((w for w in held if apart(w) >= LEAST_Z), key=lambda w: (-apart(w), w))[:features]
    vocabulary = {w: i for i, w in enumerate(best)}
    if not vocabulary:
        return None

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(1).to_pylist():
                row = np.zeros(len(vocabulary), dtype=np.uint8)
                row[[vocabulary[w] for w in tokens(text) & vocabulary.keys()]] = 1
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), batch.column(2)], names=["doc_id", "bits", "positive"])

    bounded = sample.transform(map_batches, vectors, "doc_id long, bits binary, positive boolean").limit(4 * (positives + unlabelled))
    got = sorted(bounded.collect(), key=lambda r: (r["positive"], r["doc_id"], bytes(r["bits"])))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), dtype=np.uint8).reshape(len(got), -1), axis=1)[:, : len(vocabulary)].astype(np.float32)
    is_p = np.array([r["positive"] for r in got])
    weights, bias = fit(x[is_p], x[~is_p], prior)
    return Model(vocabulary, weights, bias)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``..., score, predicted) for every row's whole text; null and empty texts score by the bias alone."""
    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            margins = np.array([model.margin(t) for t in texts]) if model else np.full(len(texts), -40.0)
            scores = _sigmoid(margins) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text")).transform(map_batches, run, ddl)


def fold_of(folds: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Rows whose crc32 of doc_id as text leaves ``held_fold`` modulo ``folds`` are held out: neither
    their labels nor their texts are learnt from; nor are rows with a null doc_id. Null labels are
    ignored, and of repeated labels the toxic one holds. Repeated rows are scored as they come,
    other columns are ignored. Without a toxic row to learn from, every score is near 0.
    """
    model = train(docs, labels, fold_of(folds) != held_fold)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(folds) == held_fold, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, ("doc_id", "held_out"))
