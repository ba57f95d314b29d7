"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two fingerprints that differ in at most 3 bits differ in at most one
bit of one of their two 32-bit halves. In each half the first 31 bits are covered by the perfect
Hamming code of length 31: its codewords are the anchors, every point lies within distance 1 of
exactly one of them (covering radius 1), and the threshold in the half is 1. A fingerprint is
copied to every anchor within 1 + 1 bits. If x and y differ in at most one bit of a half, the
anchor of x lies within 2 of y, so the pair meets there, and x is at home there. Each anchor
compares its residents with all of its members on the full 64 bits, so no link is missed or
invented. Copies with one fingerprint travel once.

An anchor with many members splits by the exact value of quarters of the other half: a pair that
differs in at most 3 bits agrees on one of four quarters. A part that is still crowded splits the
bits that it hasn't fixed yet once more in the same way. What is crowded then is near copies for
the most part, which splitting copies and doesn't set apart; they are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.llm.components import connected_components
from tessera.llm.storage import stash
from tessera.llm.words import spans, split_words

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Members of a group beyond which it is split, and how often.
CROWD, SPLITS = 4000, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(body: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 of word shingles, A-Z lower-cased; 0 without words."""
    words = split_words(body.translate(_LOWER) if body else None)
    if not words:
        return 0
    joined, starts, ends = spans(words)
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, dtype=np.int64), len(starts)
    for lo in range(0, total, 65536):
        pairs = zip(starts[lo : lo + 65536].tolist(), ends[lo : lo + 65536].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("body")).transform(map_batches, _fingerprints, "doc_id long, fp long")


# The Hamming code of length 31: position j (1..31) has syndrome j, and a word's syndrome is the
# exclusive or of the positions of its set bits; codewords have syndrome 0.


def _syndromes(halves: np.ndarray) -> np.ndarray:
    out = np.zeros(len(halves), dtype=np.uint32)
    for bit in range(31):
        out ^= ((halves >> np.uint32(bit)) & np.uint32(1)) * np.uint32(bit + 1)
    return out


def anchors_of(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, home): every codeword within 2 of the low 31 bits of each half."""
    points = halves & np.uint32(0x7FFFFFFF)
    syndrome = _syndromes(points)
    flip = np.concatenate([[0], 1 << np.arange(31)]).astype(np.uint32)
    every = np.arange(len(points))
    index, anchor, home = [every], [points ^ flip[syndrome]], [np.ones(len(points), dtype=bool)]
    for first in range(1, 32):
        second = syndrome ^ np.uint32(first)
        # two different flips j < k with j ^ k = syndrome; syndrome 0 has none, as the minimum distance is 3
        take = (second > first) & (syndrome != 0)
        index.append(every[take])
        anchor.append(points[take] ^ flip[first] ^ flip[second[take]])
        home.append(np.zeros(int(take.sum()), dtype=bool))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.asarray(batch.column(0)).view(np.uint64)
        for half in (0, 1):
            index, anchor, home = anchors_of((marks >> np.uint64(32 * half)).astype(np.uint32))
            key = anchor.astype(np.int64) | (half << 31)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(marks[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _link_group(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between residents and members of one group.

    A resident is compared with the members that no link joins it to yet, so the work of a group
    of near copies shrinks as they come together.
    """
    label, size = np.arange(len(fps)), np.ones(len(fps), dtype=np.int64)
    parts: dict[int, list[int]] = {}  # members of parts that have more than one
    left, right, count = [], [], len(fps)
    outside = np.arange(len(fps))
    for i in np.flatnonzero(home).tolist():
        if count == 1:
            break
        most = size[label[i]] * 2 > len(fps)
        if most:  # what is outside the largest part only grows less, so it need not be sought again
            outside = outside[label[outside] != label[i]]
        others = outside if most else np.flatnonzero(label != label[i])
        for j in others[np.bitwise_count(fps[others] ^ fps[i]) <= THRESHOLD].tolist():
            p, q = int(label[i]), int(label[j])
            if p == q:
                continue
            left.append(i)
            right.append(j)
            if size[p] < size[q]:
                p, q = q, p
            moved = parts.pop(q, [q])
            label[moved] = p
            parts.setdefault(p, [p]).extend(moved)
            size[p] += size[q]
            count -= 1
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by group, of which one is held: 17 bytes a member, as many as ``CROWD`` for the most part."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> pa.RecordBatch | None:
        if not table.num_rows:
            return None
        anchor, part = (np.asarray(table.column(c).combine_chunks()) for c in ("anchor", "part"))
        fps = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        home = table.column("home").combine_chunks().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(fps))
        left, right = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s > 1 and home[s:e].any():
                a, b = _link_group(fps[s:e], home[s:e])
                left.append(fps[s:e][a])
                right.append(fps[s:e][b])
        if not left:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        last = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        first_key = held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py())
        if cut == 0 and held and first_key != (int(anchor[0]), int(part[0])):
            out, held = flush(pa.Table.from_batches(held)), [batch]
        elif cut == 0:
            held.append(batch)
            continue
        else:
            out, held = flush(pa.Table.from_batches([*held, batch.slice(0, cut)])), [batch.slice(cut)]
        if out is not None:
            yield out
    if held and (out := flush(pa.Table.from_batches(held))) is not None:
        yield out


def _met(members: DataFrame) -> DataFrame:
    return members.repartition("anchor", "part").sortWithinPartitions("anchor", "part").transform(map_batches, _compare, "a long, b long")


def _pieces(mask: int) -> list[int]:
    """The set bits of a mask in four masks of bits that stand together."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [len(bits) * q // 4 for q in range(5)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for each piece of the bits its group is free in; the group's new part names piece and value."""
    for batch in batches:
        part, fps, free = (np.asarray(batch.column(c)).view(np.uint64) for c in (1, 2, 4))
        for mask in np.unique(free).tolist():
            rows = np.flatnonzero(free == np.uint64(mask))
            for q, piece in enumerate(_pieces(mask)):
                mixed = (part[rows] ^ (fps[rows] & np.uint64(piece))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q + 1)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left = np.full(len(rows), mask & ~piece, dtype=np.uint64)
                columns = [batch.column(0).take(pa.array(rows)), pa.array((mixed ^ (mixed >> np.uint64(32))).view(np.int64)), pa.array(fps[rows].view(np.int64)), batch.column(3).take(pa.array(rows)), pa.array(left.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "part", "fp", "home", "free"])


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): linked fingerprints, a spanning forest of the links met at each anchor.

    ``distinct`` has one column ``fp`` of different values. Crowded groups are counted before they
    are shuffled, so none comes whole into one task. Parts that collide only meet in vain, as
    pairs are compared on all bits.
    """
    spread = distinct.transform(map_batches, _replicas, "anchor long, fp long, home boolean")
    low = F.lit(0xFFFFFFFF).cast("long")
    other = F.when(F.col("anchor") < F.lit(1 << 31), F.bitwise_not(low)).otherwise(low)
    groups = spread.select("anchor", F.lit(0).cast("long").alias("part"), "fp", "home", other.alias("free"))
    calm = []
    for _ in range(SPLITS):
        crowds = stash(groups.groupBy("anchor", "part").count().where(F.col("count") > crowd).select("anchor", "part"), "crowds")
        if crowds.isEmpty():
            break
        calm.append(groups.join(crowds, ["anchor", "part"], "left_anti").select(*groups.columns))
        groups = stash(groups.join(crowds, ["anchor", "part"], "left_semi").select(*groups.columns).transform(map_batches, _split, "anchor long, part long, fp long, home boolean, free long"), "crowded")
    found = [_met(g.select("anchor", "part", "fp", "home")) for g in [*calm, groups]]
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest doc_id that can
    be reached over links of at most three differing bits. Null and empty texts have fingerprint
    zero and are linked like any other. Repeated rows are returned as often as they come; rows
    with a null doc_id are classed, and the id is null only if no linked row has one. Columns
    other than doc_id and text are ignored. No rows in, no rows out.
    """
    marks = stash(fingerprints(docs), "fingerprints")
    smallest = stash(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(links(smallest.select("fp"), crowd))
    rooted = stash(smallest.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = stash(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    classes = stash(rooted.join(lows, "root").select("fp", "component_id"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
