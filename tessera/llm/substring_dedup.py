"""Exact removal of repeated passages by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window whose
word sequence also starts anywhere else, in the same document or another, is removed. All
windows are judged on the input.

D = {0, 1, 4, 14, 16} is a difference cover modulo 21: for any two word positions i and j there is
a shift s < 21 with both (i + s) mod 21 and (j + s) mod 21 in D. Two equal windows that start at i
and j therefore share the 15 words from i + s on, and only runs of 15 words that start at cover
positions need to be hashed: 5 of 21 positions. Where such an anchor occurs twice, the windows
around it are candidates; a candidate extends to a match when the whole window, by a 96-bit
digest of its bytes, occurs twice.

Both rounds look for repeated keys the same way. A map task resolves the keys that occur more
than once among up to half a million by itself and sends each key once, so a key that a third of all
documents hold reaches its reducer a few times per task. Keys travel in packed blocks to buckets
by their hash; the number of buckets follows the bytes of text, so a bucket is of bounded size. A
bucket emits the places of the keys that meet another. Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.llm.words import spans, split_words

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1

_SENT_DDL = "bucket int, hit boolean, blob binary"
_HIT_DDL = "k long, d long, hits array<int>"
#: Keys that a map task holds before it sends them.
_FLUSH = 500_000
#: Bytes of text for each bucket of keys; a reducer holds the keys of one bucket at a time.
BUCKET_BYTES = 16_000_000


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, which compress better than whole numbers."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(raw: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).view(kind).reshape(n)


#: Columns of a blob's entries: key, more key, whether its places are known, document, position.
_KINDS = ("<u8", "<i4", "|u1", "<u4", "<i4")


def _write_blob(docs: np.ndarray, h: np.ndarray, v: np.ndarray, known: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Entries in the order of h, whose differences are stored. ``docs`` has rows (k, d)."""
    used, local = np.unique(doc, return_inverse=True)
    table = np.ascontiguousarray(docs[used])
    columns = (np.diff(h, prepend=np.uint64(0)), v, known.astype(np.uint8), local.astype(np.uint32), pos)
    body = np.array([len(used), len(h)], dtype="<i8").tobytes() + _planes(table.reshape(-1)) + b"".join(_planes(np.ascontiguousarray(c.astype(t))) for c, t in zip(columns, _KINDS, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(body)


def _read_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    """(k, d, h, v, known, pos) of a blob's entries."""
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n_docs, n = np.frombuffer(raw[:16], dtype="<i8").tolist()
    at = 16 + 16 * n_docs
    table, columns = _unplanes(raw[16:at], "<i8", 2 * n_docs).reshape(n_docs, 2), []
    for kind in _KINDS:
        size = np.dtype(kind).itemsize * n
        columns.append(_unplanes(raw[at : at + size], kind, n))
        at += size
    h, v, known, local, pos = columns
    return table[local, 0], table[local, 1], np.cumsum(h, dtype=np.uint64), v, known.astype(bool), pos


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        bodies = [squeeze.compress(x or b"") for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bodies, pa.binary()), *batch.columns[3:]], names=batch.schema.names)


def _cover_positions(n: int) -> np.ndarray:
    """Cover positions of a text of n words at which an anchor of some window can start."""
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(n - ANCHOR + 1)
    return at[np.isin(at % PERIOD, COVER)]


def _digests(joined: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two digests, of 64 and 32 bits, of the words [p, p + length) for every p in ``at``.

    Anchors only propose candidates, so 48 bits do for them; windows decide by 96 bits, of which
    10^13 windows are expected to give less than 0.001 false pairs.
    """
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(joined[s:e]) for s, e in zip(starts[at].tolist(), ends[at + length - 1].tolist(), strict=True)])
    cells = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    h = cells[:, 0].view(np.uint64)
    if length < WINDOW:
        return h >> np.uint64(16), np.zeros(len(h), dtype=np.int32)
    return h, cells[:, 1].astype(np.int32)


def _dealt(bucket: np.ndarray, docs: np.ndarray, h: np.ndarray, v: np.ndarray, known: np.ndarray, doc: np.ndarray, pos: np.ndarray, take: np.ndarray, by_place: bool = False) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the entries in ``take``, in their order or, which packs hits better, by place."""
    at = np.flatnonzero(take)
    at = at[np.lexsort((pos[at], doc[at], bucket[at]))] if by_place else at[np.argsort(bucket[at], kind="stable")]
    for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1) if len(at) else []:
        yield int(bucket[part[0]]), _write_blob(docs, h[part], v[part], known[part], doc[part], pos[part])


def _send(buckets: int, h: np.ndarray, v: np.ndarray, docs: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Keys met once here are asked about; of the others all places are hits, and one announces the key."""
    order = np.lexsort((v, h))
    h, v, doc, pos = (x[order] for x in (h, v, doc, pos))
    same = (h[1:] == h[:-1]) & (v[1:] == v[:-1])
    first = np.append(True, ~same)
    known = np.append(same, False) | ~first
    rows: list[tuple] = []
    # hits pass through the exchange too, dealt by document, so that one pass serves both
    rows += [(n, False, blob) for n, blob in _dealt(h % np.uint64(buckets), docs, h, v, known, doc, pos, first)]
    zeros = np.zeros_like(h), np.zeros_like(v)
    rows += [(n, True, blob) for n, blob in _dealt(docs[doc, 0].view(np.uint64) % np.uint64(buckets), docs, *zeros, known, doc, pos, known, by_place=True)]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "hit", "blob"])


def _keys(batches: Iterator[pa.RecordBatch], buckets: int, places: Callable[[int, dict], np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Digests of ``length`` words at the chosen places of each text, a bounded number at a time."""
    expand = zstandard.ZstdDecompressor()
    held: list[tuple[np.ndarray, ...]] = []
    docs: list[tuple[int, int]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, v, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        return _send(buckets, h, v, np.array(docs, dtype=np.int64), doc, pos)

    for batch in batches:
        rows = batch.to_pydict()
        for i, body in enumerate(rows["body"]):
            words = split_words(expand.decompress(body) if "hits" in rows and body else body)
            at = places(len(words), {c: rows[c][i] for c in rows if c != "body"})
            if not len(at):
                continue
            joined, starts, ends = spans(words)
            for lo in range(0, len(at), _FLUSH):
                part = at[lo : lo + _FLUSH]
                docs.append((rows["k"][i], rows["d"][i]))
                held.append((*_digests(joined, starts, ends, part, length), np.full(len(part), len(docs) - 1), part.astype(np.int32)))
                size += len(part)
                if size >= _FLUSH:
                    yield flush()
                    held, docs, size = [], [], 0
    if held:
        yield flush()


def _anchor_keys(buckets: int) -> Callable:
    return lambda batches: _keys(batches, buckets, lambda n, _: _cover_positions(n), ANCHOR)


def _windows_around(n: int, row: dict) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor at a shift below the period."""
    change = np.zeros(n + 1, dtype=np.int64)
    hits = np.asarray(row["hits"], dtype=np.int64)
    np.add.at(change, np.maximum(hits - PERIOD + 1, 0), 1)
    np.add.at(change, hits + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: max(0, n - WINDOW + 1)] > 0)


def _window_keys(buckets: int) -> Callable:
    return lambda batches: _keys(batches, buckets, _windows_around, WINDOW)


def _meet(buckets: int) -> Callable:
    """Places whose key meets another, dealt by document. Rows come sorted by bucket; one bucket's keys are held at a time."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
        k, d, h, v, known, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((v, h))
        h, v = h[order], v[order]
        same = (h[1:] == h[:-1]) & (v[1:] == v[:-1])
        out = order[(np.append(False, same) | np.append(same, False)) & ~known[order]]
        places = np.lexsort((pos[out], d[out], k[out]))
        k, d, pos = (x[out][places] for x in (k, d, pos))
        if not len(k):
            return
        first = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
        zeros = np.zeros(len(k), dtype=np.uint64), np.zeros(len(k), dtype=np.int32), np.zeros(len(k), dtype=bool)
        yield from _dealt(k.view(np.uint64) % np.uint64(buckets), np.stack([k, d], axis=1)[first], *zeros, np.cumsum(first) - 1, pos, np.ones(len(k), dtype=bool), by_place=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        current = None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])
        for batch in batches:
            for bucket, hit, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if hit:
                    yield pack([(bucket, blob)])
                    continue
                if held and bucket != current:
                    yield pack(list(flush(held)))
                    held = []
                current = bucket
                held.append(_read_blob(blob))
        if held:
            yield pack(list(flush(held)))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, d, hits), a row for each document with hits. Rows come sorted by bucket, of which one is held at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        k, d, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, d, k))
        k, d, pos = k[order], d[order], pos[order]
        # a place that repeated rows share counts once
        new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (pos[1:] != pos[:-1])) if len(k) else np.zeros(0, dtype=bool)
        k, d, pos = k[new], d[new], pos[new]
        first = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.zeros(0, dtype=bool)
        offsets = np.append(np.flatnonzero(first), len(k)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(d[first]), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32)))], names=["k", "d", "hits"])

    current = None
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and bucket != current:
                yield flush()
                held = []
            current = bucket
            k, d, _, _, _, pos = _read_blob(blob)
            held.append((k, d, pos))
    if held:
        yield flush()


def _repeated(sent: DataFrame, buckets: int) -> DataFrame:
    """(k, d, hits): for each row of the corpus, the positions whose key occurs elsewhere."""
    met = sent.repartition("bucket").sortWithinPartitions("bucket").transform(map_batches, _meet(buckets), "bucket int, blob binary")
    return met.repartition("bucket").sortWithinPartitions("bucket").transform(map_batches, _gather, _HIT_DDL)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, out = batch.to_pydict(), []
        for doc_id, body, hits in zip(rows["doc_id"], rows["body"], rows["hits"], strict=True):
            words = split_words(expand.decompress(body))
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if hits:
                starts = np.unique(np.asarray(hits, dtype=np.int64))
                gone[starts] += 1
                np.add.at(gone, np.minimum(starts + WINDOW, len(words)), -1)
            keep = np.cumsum(gone)[: len(words)] == 0
            kept = b" ".join([words[i] for i in np.flatnonzero(keep)]) if hits else b" ".join(words)
            removed = int(len(words) - keep.sum())
            out.append((doc_id, len(words), removed, hashlib.sha256(kept).hexdigest(), kept if removed else expand.decompress(body)))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)] + batch.columns[3:], names=names + batch.schema.names[3:])


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, and the columns in ``carry``) per row.

    kept_text is the text as it was if nothing is removed, else the kept words joined by one
    space; kept_sha256 is that of the joined words in either case. A null text has no words and
    comes back empty. Texts of fewer than ``WINDOW``
    words lose nothing. Repeated rows are documents of their own: of two equal rows with a whole
    window, both lose it. A null doc_id is allowed and returned. Columns other than doc_id, text
    and ``carry`` are ignored, so their names cannot clash. No rows in, no rows out.
    """
    text = F.col("text").cast("string")
    named = docs.select(
        F.coalesce(F.xxhash64("doc_id", text), F.lit(0)).alias("k"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("d"),
        text.cast("binary").alias("body"),
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)],
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    anchors = _repeated(named.select("k", "d", "body").transform(map_batches, _anchor_keys(buckets), _SENT_DDL), buckets)
    key_types = "k long, d long, body binary"
    candidates = named.select("k", "d", "body").transform(map_batches, _pack, key_types).join(anchors, ["k", "d"])
    matches = _repeated(candidates.transform(map_batches, _window_keys(buckets), _SENT_DDL), buckets)
    carried = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    whole = named.transform(map_batches, _pack, f"{key_types}, doc_id long" + (f", {carried}" if carried else ""))
    joined = whole.join(matches, ["k", "d"], "left").select("doc_id", "body", "hits", *[f"_{i}" for i in range(len(carry))])
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary" + (f", {carried}" if carried else "")
    cut = joined.transform(map_batches, _cut, ddl)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept_text").cast("string").alias("kept_text"), *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])
