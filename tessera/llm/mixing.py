"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). The cells' weights are raked: each
marginal in turn is scaled to its targets, until all agree. A document's inclusion probability
is its cell's calibrated weight over the cell's tokens, times a factor that meets the token
budget; probabilities over 1 are cut at 1 and the rest of the budget is spread over the others.
Documents are drawn by a hash of their id, so a draw can be repeated.

Marginal values without a target share one value, so there are at most
(sources + 1) * (languages + 1) * (topics + 1) cells, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGINALS = ("source", "lang", "topic")
OTHER = "~other"
MAX_CELLS = 1_000_000
#: Cells up to which they are sent to every executor, some 10 MB; more are joined by an exchange.
SENT_CELLS = 50_000
MAX_VALUES = 1000


def n_tokens(text: Column) -> Column:
    """Words of a text, which stand for its tokens."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def rake(tokens: np.ndarray, cells: list[tuple[str, ...]], targets: list[Mapping[str, float]], rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Weights of the cells, of sum 1, whose marginals meet the targets as nearly as they can.

    Targets of values without tokens are left out, and the rest of a marginal's targets scaled.
    """
    weights = tokens / tokens.sum()
    index = []
    for axis, target in enumerate(targets):
        values = sorted({c[axis] for c in cells})
        wanted = np.array([max(0.0, target.get(v, 0.0)) for v in values])
        if wanted.sum() > 0:
            index.append((np.array([values.index(c[axis]) for c in cells]), wanted / wanted.sum()))
    for _ in range(rounds):
        before = weights
        for at, wanted in index:
            have = np.bincount(at, weights=weights, minlength=len(wanted))
            weights = weights * np.divide(wanted, have, out=np.zeros_like(wanted), where=have > 0)[at]
            weights = weights / weights.sum() if weights.sum() > 0 else before
        if np.abs(weights - before).max() < tolerance:
            break
    return weights


def probabilities(weights: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Inclusion probabilities in proportion to weight over tokens, at most 1, for an expected budget."""
    rate, budget = weights / tokens, min(budget, float(tokens[weights > 0].sum()))
    full = np.zeros(len(rate), dtype=bool)
    for _ in range(len(rate) + 1):
        left, free = budget - tokens[full].sum(), ~full & (rate > 0)
        if not free.any() or left <= 0:
            break
        factor = left / (rate[free] * tokens[free]).sum()
        over = free & (rate * factor > 1)
        if not over.any():
            return np.where(full, 1.0, rate * factor)
        full |= over
    return full.astype(float)


def softened(docs: DataFrame, column: str, power: float) -> dict[str, float]:
    """Targets in proportion to a power of the observed tokens: one for each of the ``MAX_VALUES``
    largest values, and the sum of those of all others, and of null, for ``~other``."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(OTHER))
    sums = docs.groupBy(value.alias("v")).agg(F.sum("n_tokens").alias("n")).where("n > 0")
    raw = {r["v"]: float(r["n"]) ** power for r in sums.orderBy(F.desc("n"), "v").limit(MAX_VALUES).collect()}
    if len(raw) == MAX_VALUES:
        rest = sums.where(~F.col("v").isin(*raw)).agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(power)))).first()[0]
        if rest:
            raw[OTHER] = raw.get(OTHER, 0.0) + rest
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def with_rest(targets: Mapping[str, float], docs: DataFrame, column: str) -> dict[str, float]:
    """``targets``, scaled to leave ``~other`` the share of the tokens that values without a target hold."""
    listed = F.coalesce(F.col(column).isin(*targets), F.lit(False))
    total, rest = docs.agg(F.sum("n_tokens"), F.sum(F.when(~listed, F.col("n_tokens")))).first()
    if not total or not rest or OTHER in targets:
        return dict(targets)
    scale = (1 - rest / total) / sum(targets.values())
    return {k: v * scale for k, v in targets.items()} | {OTHER: rest / total}


def token_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, ``keep``...) of rows that have topic and n_tokens; null marginals are ``~other``."""
    marginal = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(OTHER)).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *map(marginal, MARGINALS), F.col("n_tokens").cast("long").alias("n_tokens"), *[F.col(c) for c in keep])


def mix(counted: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled, ``keep``...) for every row.

    ``counted`` is of the form of ``token_counts``; ``targets`` gives shares for some or all of
    source, lang and topic; ``share`` is the part of all tokens to expect in the sample. Values
    without a target count as one value, ``~other``, and are drawn only where it has a target or
    the marginal has none at all. Rows without tokens have weight and probability 0. Rows with the
    same doc_id are drawn alike; null ids draw alike too. Columns that aren't in ``keep`` are left
    out, whatever their names. No rows in, no rows out.
    """
    listed = [targets.get(m, {}) for m in MARGINALS]
    counted = counted.select("doc_id", *MARGINALS, "n_tokens", *keep)
    fold = {f"__{m}_kind": F.when(F.col(m).isin(*t), F.col(m)).otherwise(OTHER) if t else F.lit(OTHER) for m, t in zip(MARGINALS, listed, strict=True)}
    folded = counted.withColumns(fold)
    keys = list(fold)
    rows = folded.where("n_tokens > 0").groupBy(*keys).agg(F.sum("n_tokens").alias("n")).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("the targets make too many cells")
    out = ("doc_id", *MARGINALS, "n_tokens", "weight", "probability", "sampled", *keep)
    if not rows:
        zero = F.lit(0.0)
        return counted.withColumns({"weight": zero, "probability": zero, "sampled": F.lit(False)}).select(*out)
    rows.sort(key=lambda r: tuple(r[k] for k in keys))
    tokens = np.array([r["n"] for r in rows], dtype=float)
    weights = rake(tokens, [tuple(r[k] for k in keys) for r in rows], listed)
    chance = probabilities(weights, tokens, share * tokens.sum())
    cells = counted.sparkSession.createDataFrame([(*[r[k] for k in keys], float(w), float(p)) for r, w, p in zip(rows, weights, chance, strict=True)], ", ".join(f"{k} string" for k in keys) + ", __weight double, __probability double")
    joined = folded.join(F.broadcast(cells) if len(rows) <= SENT_CELLS else cells, keys, "left")
    empty = F.col("n_tokens") <= 0
    filled = {c: F.when(empty, 0.0).otherwise(F.coalesce(f"__{c}", F.lit(0.0))) for c in ("weight", "probability")}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return joined.withColumns(filled).withColumn("sampled", draw < F.col("probability")).select(*out)
