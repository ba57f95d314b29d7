"""URL filters by host-suffix and path-prefix expressions, in DataFrame operations alone.

Each different (host, path) expands into expressions host suffix + path prefix, no deeper than
the deepest rule. The first 8 hex digits of an expression's SHA-256 are equi-joined with those of
the rules; a candidate is confirmed by the full digest, and the longest confirmed rule decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import stash

PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host, up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, 'host/path') pairs."""
    rows = [(v, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def _depth(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))


def expressions(host: Column, path: Column, labels: int, depth: int, lengths: list[int]) -> Column:
    """Array of host suffix + path prefix. A path prefix ends in a slash or has a listed length."""
    parts = F.split(host, r"\.")
    hosts = [F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in range(1, labels + 1)]
    slashes = [F.when(_depth(path) >= k, F.concat(F.substring_index(path, "/", k), F.lit("/"))) for k in range(1, depth + 1)]
    others = [F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    prefixes = F.array_compact(F.array_distinct(F.array(*slashes, *others)))
    return F.flatten(F.transform(F.array_compact(F.array(*hosts)), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    A rule fits its host and all subdomains of it when the path starts with the rule's path. The
    longest rule wins; of rules that are written alike, block wins. URLs without a fitting rule,
    null URLs among them, get ``default`` and a null rule. Repeated rows are returned as they
    come. Columns other than the id and url are ignored.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    deepest = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(_depth(F.col("path"))).alias("depth"),
        F.collect_set(F.when(~F.col("path").endswith("/"), F.char_length("path"))).alias("lengths"),
    ).first()
    parsed = pages.select(F.col(id_column), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parsed = parsed.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    if deepest["labels"] is None:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    ruled = rules.select(F.concat("host", "path").alias("rule"), F.col("verdict").alias("ruled"))
    ruled = ruled.groupBy("rule").agg(F.max("ruled").alias("ruled"))  # of allow and block, block
    ruled = ruled.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    kinds = parsed.select("host", "path").distinct()
    made = expressions(F.col("host"), F.col("path"), deepest["labels"], deepest["depth"], sorted(deepest["lengths"]))
    hashed = kinds.select("host", "path", F.explode(made).alias("e")).select("host", "path", F.sha2("e", 256).alias("digest"))
    hashed = hashed.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    fits = hashed.join(ruled, "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), "rule", "ruled")).alias("m"))
    best = stash(best.select("host", "path", F.col("m.rule").alias("rule"), F.col("m.ruled").alias("ruled")), "url-rules")
    # as many rows as there are different ruled URLs: never sent whole to every executor
    return parsed.join(best.hint("merge"), ["host", "path"], "left").select(id_column, "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
