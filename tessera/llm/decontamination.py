"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are maximal runs of word characters, lower-cased. Every n-gram of an item is a possible
seed; a first pass counts, over all documents, how many hold it. A second pass looks all seeds up
in every document, cuts the region around each hit's diagonal, and aligns region and item word by
word, regions with the rarest seeds first. Rarity only orders the work: no seed that occurs is left
out, however many documents hold it. A bound from shared words, of the document and then of the
region, skips alignments that can't reach the threshold, so no match is lost to it.

Items are sent to the executors in blocks of bounded size; a benchmark beyond one block is
searched block by block. Nothing else is broadcast; documents are shuffled only to drop what several blocks found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.llm.storage import stash

SEED_WORDS = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
#: Bytes of item texts that are sent to the executors at once; there they take some eight times as much.
BLOCK_BYTES = 8_000_000
_TOKEN = re.compile(r"\w+")
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


@dataclass
class Items:
    """A block of benchmark items with their word ids and seeds, in flat arrays."""

    n: int
    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    #: Hashes of seeds in order, where each one's places begin, the item and position of each place, and the texts that hold each seed.
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    frequency: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str | None]], n: int = SEED_WORDS) -> Items:
        made = cls(n)
        for item_id, text in rows:
            if found := tokens(text):
                made.ids.append(item_id)
                made.words.append(np.array([made.vocabulary.setdefault(w, len(made.vocabulary)) for w in found], dtype=np.int32))
        hashes = [made.hashes(w, min(n, len(w))) for w in made.words]
        if hashes:
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            made.table, made.first = np.unique(h[order], return_index=True)
            made.first = np.append(made.first, len(h))
            made.owner = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])[order]
            made.place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in hashes])[order]
            made.frequency = np.zeros(len(made.table), dtype=np.int64)
        return made

    def counted(self, counts: Mapping[int, int]) -> Items:
        """The same items with the seeds that occur alone, and in how many texts."""
        keep = np.flatnonzero([int(h) in counts for h in self.table.tolist()])
        spans = [np.arange(self.first[k], self.first[k + 1]) for k in keep.tolist()]
        places = np.concatenate([np.zeros(0, dtype=np.int64), *spans])
        return replace(
            self,
            table=self.table[keep],
            first=np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int64),
            owner=self.owner[places],
            place=self.place[places],
            frequency=np.array([counts[h] for h in self.table[keep].tolist()], dtype=np.int64),
        )

    def codes(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in tokens(text)], dtype=np.int64)

    @staticmethod
    def hashes(codes: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n codes; runs with an unknown word give 0."""
        if len(codes) < n or n < 1:
            return np.zeros(0, dtype=np.uint64)
        width = len(codes) - n + 1
        h = np.full(width, n, dtype=np.uint64)
        known = np.ones(width, dtype=bool)
        for j in range(n):
            part = codes[j : width + j]
            known &= part >= 0
            h = (h ^ (part + 1).astype(np.uint64)) * np.uint64(_MIX)
            h ^= h >> np.uint64(29)
        return np.where(known, h | np.uint64(1), np.uint64(0))

    def lengths(self) -> list[int]:
        """Seed lengths in use: n, and those of items shorter than n."""
        return sorted({min(self.n, len(w)) for w in self.words})

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seeds by their place in the table) of every seed in a text."""
        where, which = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n in self.lengths() if len(self.table) else []:
            h = self.hashes(codes, n)
            if len(h):
                at = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
                found = np.flatnonzero((self.table[at] == h) & (h != 0))
                where.append(found)
                which.append(at[found])
        return np.concatenate(where), np.concatenate(which)


def align(region: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, start, end) with the span in ``region``."""
    m = len(region)
    steps = GAP * np.arange(m + 1)
    best, before = (0, 0, 0), np.zeros(m + 1, dtype=np.int64)
    starts = np.arange(m + 1)
    for word in item:
        diagonal = before[:-1] + np.where(region == word, MATCH, MISMATCH)
        row, origin = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
        up = before - GAP
        better = up > row
        row, origin = np.where(better, up, row), np.where(better, starts, origin)
        better = diagonal >= row[1:]
        take = better & (diagonal > 0)
        row[1:][take], origin[1:][take] = diagonal[take], starts[:-1][take]
        lifted = row + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(m + 1), 0))
        row, origin = reach - steps, origin[source]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(origin[j]), j)
        before, starts = row, origin
    return best


def _regions(places: list[tuple[int, int, int]], length: int, n_words: int) -> list[tuple[int, int]]:
    """Merged word ranges around the diagonals of (position, item position, frequency) hits, those with the rarest hits first."""
    slack = max(4, length // 4)
    spans = sorted({(max(0, p - q - slack), min(n_words, p - q + length + slack), f) for p, q, f in places})
    out = [spans[0]]
    for s, e, f in spans[1:]:
        # copies in a row stay apart: only nearly the same diagonal is merged
        if s - out[-1][0] <= 2 * slack and e - out[-1][0] <= 2 * (length + 2 * slack):
            out[-1] = (out[-1][0], max(e, out[-1][1]), min(f, out[-1][2]))
        else:
            out.append((s, e, f))
    return [(s, e) for s, e, _ in sorted(out, key=lambda r: (r[2], r[0]))]


def matches(items: Items, text: str | None, threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item id, score, start word, end word, seeds met) of each item that aligns with the text."""
    codes = items.codes(text)
    by_item: dict[int, list[tuple[int, int, int]]] = {}
    for p, k in zip(*(x.tolist() for x in items.hits(codes)), strict=True):
        span, often = slice(items.first[k], items.first[k + 1]), int(items.frequency[k])
        for owner, q in zip(items.owner[span].tolist(), items.place[span].tolist(), strict=True):
            by_item.setdefault(owner, []).append((p, q, often))
    if not by_item:
        return []
    held = np.bincount(codes[codes >= 0], minlength=len(items.vocabulary))
    out = []
    for k, places in sorted(by_item.items()):
        item, best = items.words[k], (0, 0, 0)
        need = threshold * MATCH * len(item)
        values, times = np.unique(item, return_counts=True)
        if MATCH * int(np.minimum(held[values], times).sum()) < need:
            continue
        counted = Counter(item.tolist())
        for s, e in _regions(places, len(item), len(codes)):
            shared = (Counter(codes[s:e].tolist()) & counted).total()
            if MATCH * shared < max(need, best[0] + 1):
                continue
            score, start, end = align(codes[s:e], item)
            if score > best[0]:
                best = (score, s + start, s + end)
        if best[0] >= need:
            out.append((items.ids[k], best[0] / (MATCH * len(item)), best[1], best[2], len(places)))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about ``block_bytes`` of text at a time."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * total / block_bytes)) if total > block_bytes else 1
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        if found := sorted((r["item_id"], r["text"]) for r in part.collect()):
            yield found


def _counting(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(items.table), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                totals[np.unique(items.hits(items.codes(text))[1])] += 1
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(items.table[met].view(np.int64)), pa.array(totals[met])], names=["seed", "n"])

    return run


def _prepared(docs: DataFrame, benchmark: DataFrame, seed_words: int, block_bytes: int) -> Iterator[Items]:
    """Each block of items, with the seeds that occur in ``docs`` and in how many of them."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for block in _blocks(benchmark, block_bytes):
        items = Items.of(block, seed_words)
        counts = texts.transform(map_batches, _counting(items), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
        yield items.counted({r["seed"] & _MASK: r["n"] for r in counts})


def find_leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, n_seeds) for each document and item that align.

    ``score`` is the alignment score over that of a whole exact copy; pairs from ``threshold`` on
    are returned, once for each row of ``docs``. Null and empty texts and items match nothing.
    Items shorter than ``seed_words`` are their own seed. Repeated items count once, repeated rows
    as they come; other columns are ignored. Empty tables give an empty result.
    """
    ddl = "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long"
    found = [docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_batches, _finding(items, threshold), ddl) for items in _prepared(docs, benchmark, seed_words, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], ddl)


def _finding(items: Items, threshold: float):
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matches(items, t, threshold)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])

    return run


def _cleaning(items: Items, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not matches(items, t, threshold) for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def _leaking(items: Items, threshold: float, names: list[str]):
    """Keys of the texts that align with an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaks = pa.array([bool(matches(items, t, threshold)) for t in batch.column(2).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=names).filter(leaks)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text aligns with no benchmark item, with all columns as they are.

    One block of items filters the rows as they are read. Of several blocks, each names the texts
    that leak by two digests, and one join drops them. Null texts stay.
    """
    blocks = list(_prepared(docs, benchmark, seed_words, block_bytes))
    if not blocks:
        return docs
    if len(blocks) == 1:
        return docs.transform(map_batches, _cleaning(blocks[0], threshold, docs.columns.index("text")), docs.schema)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spare = max(map(len, docs.columns)) * "_"  # longer than any name, so it clashes with none
    keys = {f"{spare}_k": F.xxhash64(text), f"{spare}_l": F.xxhash64(text, F.lit(1))}
    keyed = docs.select(*[v.alias(k) for k, v in keys.items()], F.col("text").cast("string").alias("text"))
    ddl = ", ".join(f"{k} long" for k in keys)
    leaks = stash(reduce(DataFrame.unionByName, [keyed.transform(map_batches, _leaking(items, threshold, list(keys)), ddl) for items in blocks]).distinct(), "leaks")
    return docs.withColumns(keys).join(leaks, list(keys), "left_anti").select(*docs.columns)
