"""The registered queries of the operators in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, license_scan, mixing, quality_rules, simhash, substring_dedup, topics, toxicity, url_filter, warc
from tessera.llm.storage import stash

#: Fixed by the contract of op6.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


#: Part of all tokens that the mix is to hold, its targets by language, and the power of their tokens that sources and topics get.
MIX_SHARE, MIX_POWER = 0.5, 0.7
MIX_LANGUAGES = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}


def mix_targets(counted: DataFrame) -> dict[str, dict[str, float]]:
    return {"source": mixing.softened(counted, "source", MIX_POWER), "lang": mixing.with_rest(MIX_LANGUAGES, counted, "lang"), "topic": mixing.softened(counted, "topic", MIX_POWER)}


def with_topics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns in ``keep`` with n_tokens and topic."""
    sized = docs.withColumn("n_tokens", mixing.n_tokens(F.col("text").cast("string")))
    return topics.with_topics(sized, (*keep, "n_tokens"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of nested folders, as the table has no paths: source/5000s/1000s/200s of doc_id/name.
    Some of each 200, 1000 and 5000 are the LICENSE files of the folder at that depth."""
    n = F.col("doc_id")
    folder = lambda *sizes: F.concat_ws("/", "source", *[F.floor(n / k).cast("string") for k in sizes])
    license_of = F.when(n % 200 < 8, folder(5000, 1000, 200)).when((n % 1000).between(100, 109), folder(5000, 1000)).when((n % 5000).between(300, 319), folder(5000))
    path = F.coalesce(F.concat(license_of, F.lit("/LICENSE")), F.concat(folder(5000, 1000, 200), F.lit("/"), n.cast("string"), F.lit(".txt")))
    files = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan.scan(files).select("doc_id", "path", "license", F.round("score", 6).alias("score"), "origin", "license_dir")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stash(mixing.token_counts(with_topics(_table(spark, sf_dir, "documents"), ("doc_id", "source", "lang"))), "token-counts")
    return mixing.mix(counted, mix_targets(counted), share=MIX_SHARE)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.records_from_pages(_table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

_OP1 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i:i+34], ' ')) AS h
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + o.j AS p FROM win JOIN rep USING (h) CROSS JOIN (SELECT unnest(range(0, 35)) AS j) o),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (r)"""

_OP4 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT i + o.j) AS n FROM win JOIN rep USING (r, g) CROSS JOIN (SELECT unnest(range(0, 5)) AS j) o GROUP BY r),
s AS (SELECT doc_id, text, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words
  OR 10 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * word_chars OR 2 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
  OR 10 * len(list_distinct(ws)) < n_words) AS kept
FROM b"""

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_QUOTED = [(n, b.replace("'", "''")) for n, b in license_scan.all_templates(license_scan.TEMPLATES)]
_OP5 = f"""
WITH t(k, name, body) AS (VALUES {", ".join(f"({k}, '{n}', '{b}')" for k, (n, b) in enumerate(_QUOTED))}),
tt AS (SELECT k, name, term, count(*) AS c FROM (SELECT k, name, unnest({_TOKENS.format("body")}) AS term FROM t) GROUP BY ALL),
v AS (SELECT DISTINCT term FROM tt),
f AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, concat_ws('/', source, doc_id // 5000, doc_id // 1000, doc_id // 200) AS leaf,
      CASE WHEN doc_id % 200 < 8 THEN concat_ws('/', source, doc_id // 5000, doc_id // 1000, doc_id // 200) WHEN doc_id % 1000 BETWEEN 100 AND 109 THEN concat_ws('/', source, doc_id // 5000, doc_id // 1000)
           WHEN doc_id % 5000 BETWEEN 300 AND 319 THEN concat_ws('/', source, doc_id // 5000) END AS held FROM documents),
d AS (SELECT r, doc_id, text, coalesce(held, leaf) AS dir, held IS NOT NULL AS named, coalesce(held || '/LICENSE', leaf || '/' || doc_id || '.txt') AS path, string_split(text, chr(10)) AS ls FROM f),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(DISTINCT r) AS df FROM (SELECT r, unnest({_TOKENS.format("text")}) AS term FROM d) JOIN v USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS w FROM v LEFT JOIN df USING (term) CROSS JOIN n),
vec AS (SELECT k, name, term, c * w / sqrt(sum(c * w * c * w) OVER (PARTITION BY k)) AS x FROM tt JOIN idf USING (term)),
lead AS (SELECT r, ls, list_position(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '{license_scan.COMMENT}') THEN 0 ELSE 1 END), 1) AS after FROM d),
units AS (SELECT r, unnest(ls) AS u FROM d UNION ALL SELECT r, unnest(regexp_split_to_array(text, '{license_scan.PARAGRAPH}')) FROM d
  UNION ALL SELECT r, array_to_string(CASE WHEN coalesce(after, 0) = 0 THEN ls ELSE ls[1:after - 1] END, chr(10)) FROM lead UNION ALL SELECT r, text FROM d WHERE named),
ut AS (SELECT u, term, count(*) AS c FROM (SELECT u, unnest({_TOKENS.format("u")}) AS term FROM (SELECT DISTINCT u FROM units)) GROUP BY ALL),
uw AS (SELECT u, term, c * coalesce(w, ln(1 + n) + 1) AS x FROM ut LEFT JOIN idf USING (term) CROSS JOIN n),
norm AS (SELECT u, sqrt(sum(x * x)) AS nn FROM uw GROUP BY u),
dot AS (SELECT u, k, name, sum(uw.x * vec.x) AS s FROM uw JOIN vec USING (term) GROUP BY ALL),
best AS (SELECT u, max({{'score': s / nn, 'license': name}}) AS m FROM dot JOIN norm USING (u) GROUP BY u),
own AS (SELECT r, max(m) AS m FROM units JOIN best USING (u) WHERE m.score >= 0.8 GROUP BY r),
h AS (SELECT dir AS holder, max(m) AS m FROM d JOIN own USING (r) WHERE named GROUP BY dir),
near AS (SELECT dir, arg_max(holder, length(holder)) AS holder FROM (SELECT DISTINCT dir FROM d) JOIN h ON dir = holder OR starts_with(dir, holder || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(own.m.license, h.m.license) AS license, round(coalesce(own.m.score, h.m.score, 0.0), 6) AS score,
  CASE WHEN own.r IS NOT NULL THEN 'own' WHEN h.holder IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.r IS NOT NULL THEN d.dir ELSE h.holder END AS license_dir
FROM d LEFT JOIN own USING (r) LEFT JOIN near USING (dir) LEFT JOIN h ON h.holder = near.holder"""

_OP6 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""


_OP8 = r"""
WITH c AS (SELECT page_id, url, md5(coalesce(html, '')) AS body,
  regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
k AS (SELECT page_id, url AS raw, body,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^.*@', ''), ':(80|443)$', ''), '^www[.]', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
  list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|fbclid|gclid|ref|sessionid|phpsessid)='))) AS q FROM c),
u AS (SELECT page_id, raw, body, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM k),
r AS (SELECT url, page_id, body, lpad(page_id::VARCHAR, 12, '0') || '-a' AS rid, make_timestamp((1700000000 + page_id * 3600) * 1000000) AS ts FROM u),
v AS (SELECT url, page_id, lpad(page_id::VARCHAR, 12, '0') || '-b' AS record_id, body AS tag, 1 AS d, make_timestamp((1700000000 + page_id * 3600 + 86400) * 1000000) AS ts FROM u
  UNION ALL SELECT url, page_id, lpad(page_id::VARCHAR, 12, '0') || '-c', md5(coalesce(raw, '')), 2, make_timestamp((1700000000 + page_id * 3600 + 172800) * 1000000) FROM u),
b AS (SELECT v.record_id, arg_max(r.rid, r.ts) AS response_id, arg_max(r.body, r.ts) AS body FROM v JOIN r ON r.url = v.url AND r.ts < v.ts GROUP BY 1),
o AS (SELECT v.record_id, v.url, v.ts, b.response_id, v.d, b.body, CASE WHEN b.response_id IS NULL THEN 'missing' WHEN b.body = v.tag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM v LEFT JOIN b USING (record_id))
SELECT record_id, url, ts, response_id, outcome, CASE WHEN outcome = 'resolved' THEN body END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || d || ';etag=' || CASE WHEN d = 1 THEN 'W/' ELSE '' END || '"' || body || '"' END AS headers FROM o"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_toxicity, op4_quality_rules, op5_license_scan, op6_url_filter, op7_mixing, op8_warc_revisits, op9_decontamination, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op4_quality_rules": _OP4, "op5_license_scan": _OP5, "op6_url_filter": _OP6, "op8_warc_revisits": _OP8}
