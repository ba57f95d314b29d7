"""Near-duplicates by exact Jaccard similarity of five-word shingles.

A text is the set of its shingles. Texts with one set are one member. Members whose 64-bit SimHash
of the set is the same or differs in at most 3 bits meet by anchor-point covering (see simhash) and
are compared first. Similar sets may lie further apart than that, by some 10 bits at the limit, and
no bounded radius holds all; so the members that covering hasn't joined go through a prefix filter.

All shingles have one order, common ones (as met in a sample) last; two sets of similarity 0.8 or more share one of their first
n - ceil(0.8 n) + 1 shingles, so members that meet at such a shingle are proposed, if their sizes
and positions there leave similarity 0.8 possible, and no pair is missed. A set's parities over
``BITS`` classes of shingles differ from another's in at most as many places as the sets differ in
shingles; a pair that differs in too many is passed over, which loses none either. Each pair left
is then compared on the whole sets.

A shingle with many members first proposes pairs with a few hubs. What the confirmed links have not
joined then is compared by parities where its members meet, so that only likely links become rows:
a spanning forest of them, again in another order where one was refuted, until a round finds no new
link; last, all likely pairs that are still apart. A pair that isn't likely is no link, so none is
lost. The sample only sets the order, never a verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.llm import simhash
from tessera.llm.components import connected_components
from tessera.llm.simhash import _LOWER, SEED
from tessera.llm.storage import stash
from tessera.llm.words import spans, split_words

SHINGLE = 5
#: Similarity from which two texts are linked, as a fraction.
NUM, DEN = 4, 5
#: Members of a shingle beyond which only pairs with ``HUBS`` of them are proposed at first.
CROWD = 32
HUBS = 8
#: Texts of the sample at least, and its part of all beyond that.
SAMPLE, PART = 4000, 8
MAX_COMMON = 100_000
BITS = 1024


def shingle_set(body: bytes | None) -> np.ndarray:
    """Sorted XXH64 of the different shingles, A-Z lower-cased; of all words where they are fewer than five."""
    words = split_words(body.translate(_LOWER) if body else None)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, starts, ends = spans(words)
    if len(words) > SHINGLE:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts)))


def mark_of(shingles: np.ndarray) -> int:
    """64-bit digest of a set as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes())).astype(np.int64))


def parities(shingles: np.ndarray) -> bytes:
    """Whether each class of shingles holds an odd number of the set's."""
    return np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def fingerprint(shingles: np.ndarray) -> int:
    """64-bit SimHash of a set, as a signed long: the bits that over half of its shingles have; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(shingles), 65536):
        some = shingles[lo : lo + 65536].astype("<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any set of enough similarity holds one among its own first."""
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, often))][: n - (NUM * n + DEN - 1) // DEN + 1]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(body).view(np.int64))], names=["h"])


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three texts of a sample hold, in order, and their counts."""
    part = max(1, min(PART, docs.count() // SAMPLE))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).select(F.col("text").cast("string").cast("binary").alias("body"))
    rows = picked.transform(map_batches, _sampled, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(MAX_COMMON).collect()
    common = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], np.array([r["count"] for r in rows], dtype=np.int64)[order]


def _marking(common: np.ndarray, counts: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x) for x in batch.column(1).to_pylist()]
            firsts = pa.array([prefix(s, common, counts).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mark_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), firsts, pa.array([parities(s) for s in sets], pa.binary()), pa.array([fingerprint(s) for s in sets], pa.int64())], names=["doc_id", "mark", "n", "firsts", "bits", "fp"])

    return run


def _possible(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that first meet at these positions can be similar enough."""
    most = 1 + np.minimum(n1 - p1, n2 - p2) - 1
    return (NUM + DEN) * most >= NUM * (n1 + n2)


def _array(column: pa.Array) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)
    return np.asarray(column).astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of one or more whole groups of rows sorted by the first column. Rows of one group are held."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(_array(c) for c in batch.columns)
        last = np.flatnonzero(cols[0] != cols[0][-1])
        if held and held[-1][0][-1] != cols[0][0]:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        if len(last):
            cut = int(last[-1]) + 1
            held.append(tuple(c[:cut] for c in cols))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = [tuple(c[cut:] for c in cols)]
        else:
            held.append(cols)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _propose(crowd: int, hubs: int | None) -> Callable:
    """Pairs of members of one shingle, whose rows (h, mark, n, pos, root) come sorted by h and mark.

    A crowded shingle proposes pairs with its first ``hubs`` members and is named in ``crowded``;
    with None it proposes all. Pairs with one root are left out. Rows of one shingle are held.
    """

    def pairs(h: np.ndarray, mark: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(h)) + 1
        starts, sizes = np.append(0, cuts), np.diff(np.concatenate([[0], cuts, [len(h)]]))
        two = starts[sizes == 2]
        left, right, crowded = [two], [two + 1], []
        many = sizes > 2
        size = 0
        for s, k in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
            large = hubs is not None and k > crowd
            if large:
                crowded.append(int(h[s]))
            for i in range(s, s + (min(hubs, k - 1) if large else k - 1)):
                other = np.arange(i + 1, s + k)
                other = other[(root[other] != root[i]) & _possible(n[i], pos[i], n[other], pos[other])]
                left.append(np.full(len(other), i))
                right.append(other)
                size += len(other)
                if size > 1_000_000:
                    yield packed(mark, n, pos, root, left, right, [])
                    left, right, size = [], [], 0
        yield packed(mark, n, pos, root, left, right, crowded)

    def packed(mark, n, pos, root, left, right, crowded) -> pa.RecordBatch:
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (left, right))
        take = (root[a] != root[b]) & _possible(n[a], pos[a], n[b], pos[b])
        ends = np.unique(np.stack([np.minimum(mark[a], mark[b])[take], np.maximum(mark[a], mark[b])[take]], axis=1), axis=0)
        nulls = [None] * len(crowded)
        return pa.RecordBatch.from_arrays([pa.array([*ends[:, 0].tolist(), *nulls], pa.int64()), pa.array([*ends[:, 1].tolist(), *nulls], pa.int64()), pa.array([None] * len(ends) + crowded, pa.int64())], names=["a", "b", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole(batches):
            yield from pairs(*columns)

    return run


def _likely(salt: int, every: bool) -> Callable:
    """Pairs of a crowded shingle that have two roots and may be links by their parities.

    Rows (h, mark, n, pos, root, bits) come sorted by h and mark. A pair that joins what earlier
    pairs of the shingle haven't is returned, in an order that ``salt`` sets; all with ``every``.
    """

    def pairs(mark: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, label, size = np.unique(root, return_inverse=True, return_counts=True)
        mixed = (mark.view(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")
        left, right = [], []
        # members of the largest part are only met by the others
        for i in order[label[order] != np.argmax(size)].tolist():
            other = np.flatnonzero(label != label[i])
            other = other[_possible(n[i], pos[i], n[other], pos[other])]
            apart = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
            over = apart * (NUM + DEN) - (DEN - NUM) * (n[other] + n[i])
            near = np.argsort(over, kind="stable")  # the likeliest first
            for j in other[near[over[near] <= 0]].tolist():
                if label[j] != label[i]:
                    left.append(i)
                    right.append(j)
                    if not every:
                        label[label == label[j]] = label[i]
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, mark, *more in _whole(batches):
            cuts = np.flatnonzero(np.diff(h)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
                x, y = pairs(mark[s:e], *(c[s:e] for c in more))
                x, y = mark[s:e][x], mark[s:e][y]
                ends = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                for lo in range(0, len(ends), 100_000):
                    part = ends[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(np.full(len(part), h[s]))], names=["a", "b", "h"])

    return run


def _met(spread: DataFrame, crowd: int, hubs: int | None) -> DataFrame:
    rows = spread.select("h", "mark", "n", "pos", "root").repartition("h").sortWithinPartitions("h", "mark")
    return rows.transform(map_batches, _propose(crowd, hubs), "a long, b long, crowded long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([mark_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["mark", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
        total = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        keep = apart * (NUM + DEN) <= (DEN - NUM) * total
        yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(keep))


def _covered(cards: DataFrame) -> DataFrame:
    """(a, b): marks whose fingerprints are one or linked by their anchors, a spanning forest of them."""
    heads = stash(cards.groupBy("fp").agg(F.min("mark").alias("head")), "shingle-heads")
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    apart = simhash.links(heads.select("fp")).distinct().join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    same = cards.join(heads, "fp").where("mark != head").select(F.col("head").alias("a"), F.col("mark").alias("b"))
    return apart.unionByName(same)


def _confirmed(pairs: DataFrame, docs: DataFrame, members: DataFrame, cards: DataFrame) -> DataFrame:
    """The pairs of marks whose whole sets have enough similarity."""
    card = lambda c: cards.select(F.col("mark").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    pairs = stash(pairs.join(card("a"), "a").join(card("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").transform(map_batches, _near, "a long, b long"), "shingle-near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    owners = stash(members.join(wanted, "mark", "left_semi").select("doc_id").distinct(), "shingle-owners")
    texts = docs.join(owners, "doc_id", "left_semi").select(F.col("text").cast("string").cast("binary").alias("body"))
    # a doc_id may have several texts; the mark tells which of them is wanted
    sets = stash(texts.transform(map_batches, _sets, "mark long, shingles binary").join(wanted, "mark", "left_semi").dropDuplicates(["mark"]), "shingle-sets")
    one, two = (sets.select(F.col("mark").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b").transform(map_batches, _confirm, "a long, b long")


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """(mark, doc_id, root) of every member."""
    roots = connected_components(links).withColumnRenamed("v", "mark")
    return stash(members.join(roots, "mark", "left").select("mark", "doc_id", F.coalesce("root", "mark").alias("root")), "shingle-roots")


def near_duplicates(docs: DataFrame, crowd: int = CROWD, hubs: int = HUBS) -> DataFrame:
    """(doc_id, mark, root) for every row of ``docs``: rows have one root if and only if linked.

    Links go over pairs of texts whose sets of five-word shingles have Jaccard similarity 0.8 or
    more; texts without words are one set. ``doc_id`` is a long that isn't null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common, counts = _common(docs)
    bodies = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body"))
    marks = stash(bodies.transform(map_batches, _marking(common, counts), "doc_id long, mark long, n int, firsts array<long>, bits binary, fp long"), "shingle-marks")
    members = stash(marks.groupBy("mark").agg(F.min("doc_id").alias("doc_id")), "shingle-members")
    cards = stash(marks.join(members, ["mark", "doc_id"], "left_semi").select("mark", "n", "bits", "fp").dropDuplicates(["mark"]), "shingle-cards")
    links = stash(_confirmed(stash(_covered(cards), "shingle-covered"), docs, members, cards), "shingle-links")
    rooted = _rooted(members, links)
    own = marks.join(rooted, ["mark", "doc_id"]).select("mark", "n", "root", F.posexplode("firsts").alias("pos", "h"))
    first = stash(_met(own, crowd, hubs), "shingle-pairs")
    more = stash(first.where("crowded IS NULL").select("a", "b").distinct(), "shingle-distinct-pairs")
    links = stash(links.unionByName(_confirmed(more, docs, members, cards)), "shingle-links")
    rooted = _rooted(members, links)
    crowds = stash(first.where("crowded IS NOT NULL").select(F.col("crowded").alias("h")).distinct(), "shingle-crowds")
    held = stash(own.select("h", "mark", "n", "pos").join(crowds, "h", "left_semi"), "shingle-crowded")
    salt, every = 0, False
    while not crowds.isEmpty():
        left = stash(held.join(crowds, "h", "left_semi").join(rooted.select("mark", "root"), "mark"), "shingle-crowded-roots")
        mixed = left.groupBy("h").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("h")
        rows = left.join(mixed, "h", "left_semi").join(cards.select("mark", "bits"), "mark").select("h", "mark", "n", "pos", "root", "bits")
        met = stash(rows.repartition("h").sortWithinPartitions("h", "mark").transform(map_batches, _likely(salt, every), "a long, b long, h long"), "shingle-likely-pairs")
        new = stash(_confirmed(met.select("a", "b").distinct(), docs, members, cards), "shingle-new-links")
        found = not new.isEmpty()
        if found:
            links = stash(links.unionByName(new), "shingle-links")
            rooted = _rooted(members, links)
        if every:
            break
        # forests whose links all hold are whole
        crowds = stash(met.join(new, ["a", "b"], "left_anti").select("h").distinct(), "shingle-crowds")
        salt, every = salt + 1, not found
    return marks.select("doc_id", "mark").join(rooted.select("mark", "root"), "mark").select("doc_id", "mark", "root")
