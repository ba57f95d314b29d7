"""Language identification with string kernels.

The kernel of two segments of text is the mean, over n = 1 to 4, of the cosine of their sets of
character n-grams (a blended spectrum of presence, n-grams hashed to fixed widths). A long text is
cut into segments of equal length, of at most ``SEGMENT`` characters, as the n-grams of more would
fill the widths; the scores of a text are the means of its segments' scores. A bounded sample of
labelled segments gives landmarks; the Nyström map of the kernel to the landmarks is followed by
one ridge regression per language against the rest. Segments are scored in batches: presence rows
times landmarks, times the regression's weights.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches

WIDTHS = (256, 2048, 4096, 4096)
#: Labelled rows to learn from: about so many a language, and in all (then fewer a language, but not below LEAST).
PER_LANGUAGE, SAMPLE, LEAST = 400, 20_000, 20
#: Landmarks at least, and of each language where that is more.
LANDMARKS, LANDMARKS_EACH = 192, 2
#: Values of lang beyond which a column can't be one of languages.
MAX_LANGUAGES = 2000
RIDGE = 1e-3
BATCH = 128
SEGMENT = 4096
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def segments(text: str | None) -> list[str]:
    """The text in pieces of equal length that overlap, so that every n-gram lies in one."""
    text = text or ""
    pieces = max(1, -(-len(text) // SEGMENT))
    size = -(-len(text) // pieces)
    return [text[i * size : (i + 1) * size + len(WIDTHS) - 1] for i in range(pieces)]


def presence(segment: str) -> np.ndarray:
    """0/1 over all hashed n-grams of the lower-cased segment; anything but letters counts as a space."""
    out = np.zeros(sum(WIDTHS), dtype=np.uint8)
    _mark(segment, out)
    return out


def _mark(text: str, out: np.ndarray) -> None:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = (codes >= 0xAA) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letters, codes, 32).astype(np.uint32)
    at = 0
    for n, width in enumerate(WIDTHS, 1):
        if len(codes) >= n:
            mixed = np.zeros(len(codes) - n + 1, dtype=np.uint32)
            for j in range(n):
                mixed = (mixed ^ codes[j : len(codes) - n + 1 + j]) * _MULTIPLIERS[j]
                mixed ^= mixed >> np.uint32(15)
            out[at + mixed % np.uint32(width)] = 1
        at += width


def scaled(rows: np.ndarray) -> np.ndarray:
    """Presence rows with each n-gram length at norm 1/2, so that inner products are kernel values."""
    out = rows.astype(np.float32)
    at = 0
    for width in WIDTHS:
        block = out[:, at : at + width]
        norms = np.sqrt(block.sum(axis=1, keepdims=True))
        block /= np.maximum(norms, 1) * np.sqrt(len(WIDTHS))
        at += width
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return (scaled(rows) @ self.landmarks.T) @ self.weights


def fit(rows: np.ndarray, langs: list[str], landmarks: int | None = None, ridge: float = RIDGE) -> Model:
    """Landmarks are taken in turn from each language, in the order of the rows."""
    languages = sorted(set(langs))
    kinds = np.searchsorted(languages, langs)
    turn = np.zeros(len(kinds), dtype=np.int64)
    for k in range(len(languages)):
        turn[kinds == k] = np.arange((kinds == k).sum())
    landmarks = landmarks or max(LANDMARKS, LANDMARKS_EACH * len(languages))
    marks = scaled(rows[np.lexsort((kinds, turn))[:landmarks]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    sound = values > 1e-8 * max(values.max(), 1e-12)
    nystrom = vectors[:, sound] / np.sqrt(values[sound])
    z = np.concatenate([scaled(rows[lo : lo + 1024]) @ marks.T for lo in range(0, len(rows), 1024)]).astype(np.float64) @ nystrom
    targets = (kinds[:, None] == np.arange(len(languages))).astype(np.float64)
    balance = 1 / np.bincount(kinds, minlength=len(languages))[kinds]
    balance *= len(kinds) / balance.sum()
    zw = z * balance[:, None]
    solved = np.linalg.solve(zw.T @ z + ridge * len(z) * np.eye(z.shape[1]), zw.T @ targets)
    return Model(languages, marks, (nystrom @ solved).astype(np.float32))


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment of each text with a letter in it, picked by its id."""
    for batch in batches:
        ids, texts, bits = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
        for i, text in zip(ids, texts, strict=True):
            lettered = [x for x in segments(text) if has_letter(x)]
            bits.append(np.packbits(presence(lettered[(i or 0) % len(lettered)])).tobytes() if lettered else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])


def train(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE, landmarks: int | None = None) -> Model | None:
    """Fit on about ``per_language`` rows of each language, chosen by a hash of doc_id.

    Of many languages, about ``sample_rows`` rows in all, but ``LEAST`` of each, are learnt from;
    every language is. None if no row can be learnt from.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    if not counts:
        return None
    wanted = max(LEAST, min(per_language, sample_rows // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 2 * wanted / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # twice as many are drawn as are wanted, so that chance leaves no language short
    sample = rows.where(draw < share[F.col("lang")]).transform(map_batches, _presence_rows, "doc_id long, lang string, bits binary").where("bits IS NOT NULL")
    found: dict[str, list] = {}
    for r in sorted(sample.limit(8 * wanted * len(counts)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], bytes(r["bits"]))):
        if len(mine := found.setdefault(r["lang"], [])) < wanted:
            mine.append(bytes(r["bits"]))
    if not found:
        return None
    langs = [lang for lang in sorted(found) for _ in found[lang]]
    bits = np.frombuffer(b"".join(b for lang in sorted(found) for b in found[lang]), dtype=np.uint8).reshape(len(langs), -1)
    return fit(np.unpackbits(bits, axis=1)[:, : sum(WIDTHS)], langs, landmarks)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``..., lang_pred, score). Null texts and texts without a letter are ``und`` with score 0."""
    kept = [F.col(c) for c in keep]
    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(batch.num_columns - 1)
            for lo in range(0, batch.num_rows if model else 0, BATCH):
                part = texts.slice(lo, BATCH).to_pylist()
                total, pieces = np.zeros((len(part), len(model.languages))), np.zeros(len(part), dtype=np.int64)
                queue = ((i, x) for i, t in enumerate(part) for x in segments(t) if has_letter(x))
                while some := list(itertools.islice(queue, BATCH)):
                    owner = np.array([i for i, _ in some])
                    np.add.at(total, owner, model.scores(np.stack([presence(x) for _, x in some])))
                    np.add.at(pieces, owner, 1)
                found = total / np.maximum(pieces, 1)[:, None]
                for i in np.flatnonzero(pieces).tolist():
                    best = int(found[i].argmax())
                    langs[lo + i], scores[lo + i] = model.languages[best], min(1.0, max(0.0, float(found[i, best])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*kept, F.col("text").cast("string").alias("_text")).transform(map_batches, run, ddl)


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Rows whose crc32 of doc_id as text leaves ``held_fold`` modulo ``folds`` are held out; rows
    with a null doc_id are neither held out nor learnt from. Predictions use the text alone.
    Repeated rows are returned as they come; other columns are ignored. If no row can be learnt
    from, every prediction is ``und`` with score 0.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = train(docs, fold.isNotNull() & (fold != held_fold))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, ("doc_id", "held_out"))
