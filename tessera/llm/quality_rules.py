"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Base statistics are computed once for every text. Each rule is a condition on the text and those
statistics. On a bounded sample the cascade times every rule and counts what it rejects of what the
rules before it leave, and takes next the rule of most rejections per cost; a ``CASE WHEN`` chain
evaluates them in that order and stops at the first that rejects. The order changes the work and
the named rule, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NGRAM = 5
SAMPLE_ROWS = 2000
#: Times that a rule is evaluated on each row of the sample, so that its own time shows.
REPEATS = 20


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over ``text`` and the base columns; null counts as false."""

    name: str
    rejects: Column


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_ngram_words(words: Column, n: int = NGRAM) -> Column:
    """Words in windows of ``n`` words that occur twice or more, the first one included.

    Window hashes are sorted with their positions, so equal windows are neighbours; the covered
    length is the sum of the gaps between marked positions, each at most ``n``. Texts without a
    repeated hash, the common case, stop after one ``array_distinct``.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))

    def marked(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(k, k + 1) | same(k, k - 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")),
            lambda a, x: F.struct((a["sum"] + F.least(F.lit(n), x - a["last"])).alias("sum"), x.alias("last")),
            lambda a: a["sum"],
        )

    def total(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = _let(pairs, lambda s: _let(marked(s), covered))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(found)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(_let(_let(hashes, windows), total)).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Null and blank texts have zeros throughout.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def counts(w: Column, lines: Column) -> Column:
        values = (
            F.size(w).cast("long"),
            F.char_length(F.translate(text, SPACES, "")).cast("long"),
            _count(text, SYMBOLS).cast("long"),
            F.size(lines).cast("long"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            repeated_ngram_words(w),
        )
        return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    stats = _let(words_of(text), lambda w: _let(lines, lambda x: counts(w, x)))
    return docs.withColumn("__q", stats).select("*", *[F.col(f"__q.{n}").alias(n) for n in names]).drop("__q")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules on whole texts: symbols, repeated lines, word length, capitals, exclamations, vocabulary."""
    text, n = F.coalesce(F.col("text"), F.lit("")), F.col("n_words")
    distinct = F.size(F.array_distinct(words_of(text)))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 4 * F.col("n_lines")),
        Rule("word_length", (2 * F.col("word_chars") < 5 * n) | (F.col("word_chars") > 12 * n)),
        Rule("capitals", 10 * _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 3 * F.col("word_chars")),
        Rule("exclamations", 2 * _count(text, "!") > n),
        Rule("vocabulary", 10 * distinct < n),
    ]


def _seconds(sample: DataFrame, condition: Column) -> float:
    """Wall time of evaluating a condition ``REPEATS`` times on each row: the least of three jobs, the first of which compiles."""
    many = sample.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    times = []
    for _ in range(3):
        began = time.perf_counter()
        many.agg(F.count_if(condition)).first()
        times.append(time.perf_counter() - began)
    return min(times)


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds a row, share it rejects of what the rules before it leave), in the order to apply.

    Measured on about ``sample_rows`` rows. A rule's cost is the time of a job that evaluates it
    many times over less that of a job that evaluates nothing. The verdicts of all rules are
    counted together, so what each rejects after others is exact on the sample.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = base_statistics(docs.sample(share, seed=17)).persist()
    try:
        verdicts = F.array(*[F.coalesce(r.rejects, F.lit(False)) for r in rules])
        patterns = [(tuple(r["v"]), r["count"]) for r in sample.groupBy(verdicts.alias("v")).count().collect()] if rules else []
        rows = max(1, sum(n for _, n in patterns))
        idle = _seconds(sample, F.col("__k") < 0)
        costs = [max(_seconds(sample, r.rejects) - idle, 1e-9) / (rows * REPEATS) for r in rules]
    finally:
        sample.unpersist()
    ordered, left = [], set(range(len(rules)))
    while left:
        rest = sum(n for _, n in patterns)
        rejected = {i: sum(n for v, n in patterns if v[i]) for i in left}
        i = min(left, key=lambda i: (-rejected[i] / costs[i], costs[i], rules[i].name))
        ordered.append((rules[i], costs[i], rejected[i] / max(1, rest)))
        patterns, left = [(v, n) for v, n in patterns if not v[i]], left - {i}
    return ordered


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules are not evaluated."""
    chain = None
    for rule in rules:
        chain = F.when(rule.rejects, rule.name) if chain is None else chain.when(rule.rejects, rule.name)
    return chain if chain is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base statistics, base_failed, rejected_by and kept.

    A text is kept if the base doesn't fail it and no rule rejects it. Null and blank texts fail
    the base. Every row is judged, repeated rows alike; a column of the input that has the name
    of a result column is replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
    docs = docs.drop(*made, "__q")
    ordered = order_rules(docs, rules if rules is not None else default_rules(), sample_rows)
    judged = base_statistics(docs).withColumn("base_failed", base_failed())
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade([r for r, _, _ in ordered])))
    return judged.withColumn("kept", F.col("rejected_by").isNull())
