"""WARC records, and resolution of not-modified revisits.

A revisit with profile server-not-modified (HTTP 304) has no body: it stands for the latest
earlier full response of its URL. Resolution is an as-of join by canonical URL. Validators are
checked, and the revisit's header fields replace those of the response where HTTP lets a 304
update a stored response.

The as-of join has two levels, so that no URL's whole history meets in one task: within
(URL, day) a window carries the last response forward, and a second window over (URL, day)
summaries gives what earlier days leave. Times count at the resolution of the table, and records
of one URL and time are summed up before, so both windows are bounded by the calendar however
many records a URL has. Headers and bodies don't take part; they are joined by record id.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.llm.storage import stash

# Header fields that a 304 must not change in a stored response (RFC 9111, 3.2;
# hop-by-hop fields of RFC 9110, 7.6.1; fields that describe the stored body).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Compressed bytes that are given to the decompressor at once.
PIECE = 1 << 14
_DROPPED_QUERY = r"(?i)^(utm_[a-z]+|fbclid|gclid|ref|sessionid|phpsessid)="


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, userinfo, default ports, a leading www., tracking parameters and a final slash go;
    the host is lower-cased and parameters are sorted. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(_DROPPED_QUERY)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Header map of a stored response after a 304; names compare in lower case."""
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    allowed = F.map_filter(lower(fresh), lambda k, _: ~k.isin(*KEPT_FIELDS))
    base = F.map_filter(lower(stored), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(base, allowed))))


def latest_before(queries: DataFrame, states: DataFrame) -> DataFrame:
    """(url, ts, response_id): for each (url, ts) of ``queries`` the state of ``states`` last before ts.

    ``queries`` has distinct (url, ts), ``states`` has distinct (url, ts) with response_id.
    """
    day = F.date_trunc("DAY", F.col("ts")).alias("day")
    events = queries.select("url", "ts", day, F.lit(None).cast("string").alias("response_id"), F.lit(0).alias("side"))
    events = events.unionByName(states.select("url", "ts", day, "response_id", F.lit(1).alias("side")))
    within = W.partitionBy("url", "day").orderBy("ts", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    asked = stash(events.withColumn("found", F.last("response_id", ignorenulls=True).over(within)).where("side = 0").select("url", "ts", "day", "found"), "asof-day")
    days = events.groupBy("url", "day").agg(F.max(F.when(F.col("side") == 1, F.struct("ts", "response_id"))).alias("left"))
    before = W.partitionBy("url").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.withColumn("carry", F.last("left", ignorenulls=True).over(before)["response_id"]).where("carry IS NOT NULL").select("url", "day", "carry")
    carried = stash(carried, "asof-carry")
    return asked.join(carried, ["url", "day"], "left").select("url", "ts", F.coalesce("found", "carry").alias("response_id"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit with status 304: what it stands for.

    ``records`` has record_id, url, ts (timestamp), kind ('response' or 'revisit'), status, headers
    (map) and digest of the body. Result: record_id, url (canonical), ts, response_id, outcome,
    digest, headers. outcome is ``resolved``, ``mismatch`` (the validators differ), or ``missing``
    (no full response before). An ETag decides if both sides have one (compared weakly), else
    Last-Modified if both have it; without a common validator the response is taken. digest and
    headers are null unless resolved. Only responses of status 200 with a URL and time count; of
    those at one time, the greatest record_id. Revisits without URL or time are missing; repeated
    rows are resolved alike. Other columns are ignored.
    """
    known = records.select(F.col("record_id").cast("string").alias("record_id"), canonical_url(F.col("url")).alias("url"), "ts", "kind", "status", "headers", "digest")
    revisits = known.where((F.col("kind") == "revisit") & (F.col("status") == 304))
    full = known.where((F.col("kind") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull())
    states = full.groupBy("url", "ts").agg(F.max("record_id").alias("response_id"))
    asked = revisits.where(F.col("url").isNotNull() & F.col("ts").isNotNull()).select("url", "ts").distinct()
    answers = stash(latest_before(asked, states), "revisit-answers")
    bodies = full.groupBy("record_id").agg(F.max(F.struct("ts", "digest", F.to_json("headers").alias("h"))).alias("b"))
    bodies = stash(bodies.select(F.col("record_id").alias("response_id"), F.col("b.digest").alias("digest"), F.from_json("b.h", "map<string,string>").alias("stored")), "revisit-bodies")
    found = revisits.drop("digest").join(answers, ["url", "ts"], "left").join(bodies, "response_id", "left")

    def field(headers: str, name: str) -> Column:
        lowered = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
        return F.try_element_at(lowered, F.lit(name))

    etags = _weak(field("headers", "etag")), _weak(field("stored", "etag"))
    dates = field("headers", "last-modified"), field("stored", "last-modified")
    both = lambda x: x[0].isNotNull() & x[1].isNotNull()
    valid = F.when(both(etags), etags[0] == etags[1]).when(both(dates), dates[0] == dates[1]).otherwise(True)
    outcome = F.when(F.col("response_id").isNull(), "missing").when(valid, "resolved").otherwise("mismatch")
    judged = found.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return judged.select("record_id", "url", "ts", "response_id", "outcome", F.when(good, F.col("digest")).alias("digest"), F.when(good, merge_headers(F.col("stored"), F.col("headers"))).alias("headers"))


def records_from_pages(pages: DataFrame) -> DataFrame:
    """WARC-like records of a crawl of ``pages`` (page_id, url, html).

    Page n is fetched at hour n; its ETag is the MD5 of its body. A day later it is revisited with
    that ETag, and two days later with the ETag of its URL's text in place of the body's, which
    a check of validators refuses. Null bodies count as empty.
    """
    body = F.md5(F.coalesce("html", F.lit("")))
    at = lambda days: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 3600 + days * 86400)
    text = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    kinds = F.array(
        F.struct(F.lit("a").alias("part"), at(0).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), text(("ETag", F.concat(F.lit('"'), body, F.lit('"'))), ("Content-Type", F.lit("text/html")), ("Date", F.lit("0"))).alias("headers"), body.alias("digest")),
        F.struct(F.lit("b").alias("part"), at(1).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), text(("etag", F.concat(F.lit('W/"'), body, F.lit('"'))), ("Content-Type", F.lit("text/plain")), ("Date", F.lit("1"))).alias("headers"), F.lit(None).cast("string").alias("digest")),
        F.struct(F.lit("c").alias("part"), at(2).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), text(("ETag", F.concat(F.lit('"'), F.md5(F.coalesce("url", F.lit(""))), F.lit('"'))), ("Date", F.lit("2"))).alias("headers"), F.lit(None).cast("string").alias("digest")),
    )
    return pages.select("page_id", "url", F.explode(kinds).alias("r")).select(F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit("-"), F.col("r.part")).alias("record_id"), "url", "r.ts", "r.kind", "r.status", "r.headers", "r.digest")


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, expanded one at a time; what breaks off or follows them is left out."""
    view, at = memoryview(data), 0
    while view[at : at + 2] == b"\x1f\x8b":
        member, parts = zlib.decompressobj(16 + zlib.MAX_WBITS), []
        while not member.eof and at < len(view):
            piece = view[at : at + PIECE]
            try:
                parts.append(member.decompress(piece))
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
        yield b"".join(parts)
        if not member.eof:
            return


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file, gzipped or not.

    Each gzip member is expanded alone, and its bytes are looked at once. A record that breaks off
    is dropped with what follows it.
    """
    if data[:2] == b"\x1f\x8b":
        for plain in _members(data):
            yield from parse_warc(plain)
        return
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        fields = {}
        for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "0")
        length = int(length) if length.isdigit() else 0
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            return
        yield fields, block
        at = end + 4 + length


def format_warc(fields: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """One record, as a gzip member of its own if ``compress``."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields.items() if k.lower() != "content-length"], f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, mtime=0) if compress else record


def http_parts(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """(status, header fields, body) of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    words = lines[0].split(" ")
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
    return status, {n.strip(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:]) if n}, body


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows: list[tuple] = []
            for fields, block in parse_warc(content):
                http = fields.get("content-type", "").startswith("application/http") or fields.get("warc-type") in ("response", "revisit")
                status, headers, body = http_parts(block) if http else (None, {}, block)
                rows.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-type"), status, list(headers.items()), body))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as (record_id, url, ts, kind, status, headers, body, digest).

    A file is read by one task and must fit in its memory, as crawl archives of about 1 GB do.
    """
    ddl = "record_id string, url string, date string, kind string, status int, headers map<string,string>, body binary"
    parsed = spark.read.format("binaryFile").load(path).select("content").transform(map_batches, _parsed, ddl)
    return parsed.select("record_id", "url", F.try_to_timestamp("date").alias("ts"), "kind", "status", "headers", "body", F.md5("body").alias("digest"))
