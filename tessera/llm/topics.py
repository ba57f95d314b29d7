"""Topics of texts by spherical k-means over all documents, for tables that have none.

A text is the set of its words of middling document frequency, as a unit vector weighed by inverse
document frequency. What all texts of a language share is no topic: the mean vector of the text's
language is taken off. Documents then move between the nearest of ``TOPICS`` centres, which are
the directions of their members' sums, for some rounds.

Every statistic is a sum over all documents, made by tasks in parts and added up in whole numbers,
so it doesn't depend on the order; only the first centres are chosen among a bounded sample. The
driver holds the vocabulary, the centres and the means, whose sizes are fixed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.llm.storage import stash

TOPICS = 8
VOCABULARY = 4096
#: Share of the documents that hold a word of the vocabulary at most and at least, and documents at least.
MOST, RARE, LEAST = 0.2, 1e-4, 5
#: Languages with a mean of their own, the largest; all others share one.
LANGUAGES = 50
ROUNDS = 6
#: Documents among which the first centres are chosen.
SEEDS = 2000
HELD_WORDS = 200_000
UNIT = 1 << 20
#: Documents whose vectors are worked on at once.
BATCH = 2000


def words(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    languages: dict[str, int]
    means: np.ndarray
    centres: np.ndarray
    #: Product of each centre with each language's mean.
    offset: np.ndarray

    def around(self, centres: np.ndarray) -> Model:
        return replace(self, centres=centres, offset=centres @ self.means.T)

    def group(self, lang: str | None) -> int:
        return self.languages.get(lang, len(self.languages))

    def bag(self, text: str | None) -> np.ndarray:
        place = self.vocabulary
        return np.array(sorted(place[w] for w in words(text) & place.keys()), dtype=np.uint16)

    def vectors(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, place, value) of the entries of the unit vectors of bags that aren't empty."""
        sizes = np.array([len(b) for b in bags])
        owner, place = np.repeat(np.arange(len(bags)), sizes), np.concatenate(bags)
        values = self.weights[place]
        norms = np.sqrt(np.bincount(owner, values * values, len(bags)))
        return owner, place, values / norms[owner]

    def topics(self, bags: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
        """The nearest centre of each bag; -1 without words of the vocabulary."""
        found = np.full(len(bags), -1)
        for lo in range(0, len(bags), BATCH):
            some = [i for i in range(lo, min(lo + BATCH, len(bags))) if len(bags[i])]
            if some:
                owner, place, values = self.vectors([bags[i] for i in some])
                near = np.stack([np.bincount(owner, c[place] * values, len(some)) for c in self.centres])
                found[some] = (near - self.offset[:, groups[some]]).round(9).argmax(axis=0)
        return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    row = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(text))
        if len(counts) > HELD_WORDS:
            yield row(counts)
            counts = Counter()
    yield row(counts)


def _bags(model: Model) -> Callable:
    """The last two columns, text and lang, become group and bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [model.bag(t).tobytes() for t in batch.column(batch.num_columns - 2).to_pylist()]
            groups = [model.group(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(groups, pa.int32()), pa.array(bags, pa.binary())], names=[*batch.schema.names[:-2], "__grp", "__bag"])

    return run


def _held(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags and groups of a batch's last two columns."""
    bags = [np.frombuffer(x, dtype=np.uint16) for x in batch.column(batch.num_columns - 1).to_pylist()]
    return bags, np.asarray(batch.column(batch.num_columns - 2))


def _sums(model: Model, rows: int, by_topic: bool) -> Callable:
    """Sums of unit vectors by topic or group, as (row, place, sum in units); place -1 - g counts the members of group g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, kinds = len(model.vocabulary), len(model.languages) + 1
        total, members = np.zeros(rows * width, dtype=np.int64), np.zeros(rows * kinds, dtype=np.int64)
        for batch in batches:
            every, groups_of = _held(batch)
            for lo in range(0, len(every), BATCH):
                bags, groups = every[lo : lo + BATCH], groups_of[lo : lo + BATCH]
                row = model.topics(bags, groups) if by_topic else groups
                owner, place, values = model.vectors(bags)
                total += np.bincount(row[owner] * width + place, (values * UNIT).round(), rows * width).astype(np.int64)
                members += np.bincount(row * kinds + groups, minlength=rows * kinds)
        for table, step, sign in ((total, width, 1), (members, kinds, -1)):
            at = np.flatnonzero(table)
            place = at % step if sign > 0 else -1 - at % step
            yield pa.RecordBatch.from_arrays([pa.array(at // step, pa.int32()), pa.array(place, pa.int32()), pa.array(table[at])], names=["row", "place", "n"])

    return run


def _summed(model: Model, bags: DataFrame, rows: int, by_topic: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums, members by group) over all bags."""
    found = bags.transform(map_batches, _sums(model, rows, by_topic), "row int, place int, n long").groupBy("row", "place").agg(F.sum("n").alias("n")).collect()
    total, members = np.zeros((rows, len(model.vocabulary))), np.zeros((rows, len(model.languages) + 1))
    for r in found:
        if r["place"] >= 0:
            total[r["row"], r["place"]] = r["n"] / UNIT
        else:
            members[r["row"], -1 - r["place"]] = r["n"]
    return total, members


def fit(docs: DataFrame, topics: int = TOPICS, keep: tuple[str, ...] = ()) -> tuple[Model | None, DataFrame | None]:
    """A model of ``docs`` (text, lang), and their bags with the columns in ``keep``; None if no word of theirs is of middling frequency."""
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"), F.col("lang").cast("string").alias("__lang"))
    n = texts.count()
    counts = texts.select("__text").transform(map_batches, _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= max(RARE * n, min(LEAST, max(1, n // 20)))) & (F.col("n") <= max(MOST * n, 1))).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    if not band:
        return None, None
    langs = texts.groupBy("__lang").count().where("__lang IS NOT NULL").orderBy(F.desc("count"), "__lang").limit(LANGUAGES).collect()
    languages = {r["__lang"]: i for i, r in enumerate(langs)}
    weights = np.log((1 + n) / np.array([1 + r["n"] for r in band]))
    model = Model({r["word"]: i for i, r in enumerate(band)}, weights, languages, np.zeros((len(languages) + 1, len(band))), np.zeros((topics, len(band))), np.zeros((topics, len(languages) + 1)))
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    whole = stash(texts.transform(map_batches, _bags(model), f"{kept}__grp int, __bag binary"), "bags")
    bags = whole.where(F.length("__bag") > 0).select("__grp", "__bag")
    total, members = _summed(model, bags, len(languages) + 1, False)
    model.means = total / np.maximum(members.sum(axis=1, keepdims=True), 1)

    # tasks offer few more than are wanted, however many tasks there are
    draw = F.pmod(F.xxhash64("__bag", F.lit(6)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    offered = bags.where(draw < min(1.0, 4 * SEEDS / max(1, n)))
    seeds = offered.orderBy(F.xxhash64("__bag", F.lit(5)), "__grp").limit(SEEDS).collect() or bags.limit(1).collect()
    owner, place, values = model.vectors([np.frombuffer(r["__bag"], dtype=np.uint16) for r in seeds])
    rest = -model.means[[r["__grp"] for r in seeds]]
    rest[owner, place] += values
    rest /= np.maximum(np.sqrt((rest * rest).sum(axis=1, keepdims=True)), 1e-12)
    near, centres = np.full(len(rest), -1.0), np.zeros_like(model.centres)
    for k in range(min(topics, len(rest))):  # each first centre is the document farthest from those before
        centres[k] = rest[int(near.round(9).argmin())]
        near = np.maximum(near, rest @ centres[k])
    model = model.around(centres)
    for _ in range(ROUNDS):
        total, members = _summed(model, bags, topics, True)
        moved = total - members @ model.means
        norms = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
        model = model.around(np.where(norms > 1e-9, moved / np.maximum(norms, 1e-12), model.centres))
    return model, whole


def _named(found: np.ndarray) -> pa.Array:
    return pa.array([f"t{k}" if k >= 0 else None for k in found.tolist()], pa.string())


def assign(bags: DataFrame, model: Model) -> DataFrame:
    """The bags that ``fit`` made, with ``topic``: ``t0`` and so on, null without words of the vocabulary."""
    keep = bags.columns[:-2]
    ddl = "".join(f"`{c}` {bags.schema[c].dataType.simpleString()}, " for c in keep) + "topic string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _named(model.topics(*_held(batch)))], names=[*keep, "topic"])

    return bags.transform(map_batches, run, ddl)


def with_topics(docs: DataFrame, keep: tuple[str, ...], topics: int = TOPICS) -> DataFrame:
    """The columns in ``keep`` of ``docs`` (text, lang), which can't be named topic, with each text's topic.

    Null texts and texts without words of the vocabulary have none; repeated rows have the same.
    """
    model, bags = fit(docs, topics, keep)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias("topic"))
    return assign(bags, model)
