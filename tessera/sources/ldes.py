"""Linked data event streams: pages to members and relations, the frontier, and a Spark data source."""

from __future__ import annotations

import heapq
import json
import time
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tessera.operators.closure import reach, subgraph
from tessera.operators.quads import COLUMNS
from tessera.sources.http import Executor, Request, Response, executor_from, follow_redirects, limited
from tessera.sources.rdf_text import parse
from tessera.sources.spool import Spool
from tessera.vocabulary import DCT, LDES, RDF_TYPE, TREE

DEFAULT_MAX_AGE = 60
PROPERTIES = ("timestampPath", "versionOfPath")


# pages already read into quads


def relations(pages: DataFrame) -> DataFrame:
    """(model_id, node): the nodes that a page's relations point to; their kinds and values don't matter."""
    links = pages.where(F.col("p") == TREE + "relation").select("model_id", F.col("o").alias("s"))
    return pages.where(F.col("p") == TREE + "node").select("model_id", "s", F.col("o").alias("node")).join(links, ["model_id", "s"], "left_semi").select("model_id", "node").distinct()


def members(pages: DataFrame, timestamp_path: str | None = None) -> DataFrame:
    """Quads of each page's members with columns page and member_id; ``model_id`` is the member's.

    A member is what can be reached from an object of tree:member. With ``timestamp_path`` a
    column created_at has its wall-clock time.
    """
    roots = pages.where((F.col("p") == TREE + "member") & (F.col("o_kind") == "iri")).select("model_id", F.col("o").alias("root")).distinct()
    body = pages.where(~F.col("p").isin(TREE + "member", TREE + "relation", TREE + "view"))
    found = subgraph(body, roots).withColumn("page", F.col("model_id")).withColumn("member_id", F.col("root")).withColumn("model_id", F.col("root"))
    if timestamp_path is None:
        return found.select(*COLUMNS, "page", "member_id")
    own = found.where((F.col("p") == timestamp_path) & (F.col("s") == F.col("member_id"))).groupBy("page", "member_id").agg(F.min("o").alias("_t"))
    stamp = F.try_to_timestamp(F.regexp_replace("_t", r"(Z|[+-]\d\d:\d\d)$", "")).cast("timestamp_ntz")
    return found.join(own, ["page", "member_id"], "left").withColumn("created_at", stamp).select(*COLUMNS, "page", "member_id", "created_at")


def member_order(rows: DataFrame, page: str = "page_seq", created: str = "created_at", key: str = "member_id") -> DataFrame:
    """Members numbered in the order in which they are given out: by page, then time, then id."""
    w = W.partitionBy(page).orderBy(created, key)
    return rows.withColumn("position", F.row_number().over(w))


def page_dedup(received: DataFrame, fetched: DataFrame) -> DataFrame:
    """Members of a mutable page that it hasn't given before; both have (page, member_id)."""
    return fetched.join(received.select("page", "member_id").distinct(), ["page", "member_id"], "left_anti")


def mutability(header: Column) -> tuple[Column, Column]:
    """(mutable, max age in seconds) by a Cache-Control header; none means mutable for a minute."""
    mutable = ~F.contains(F.coalesce(header, F.lit("")), F.lit("immutable"))
    age = F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?:^|, )max-age=(\d+)", 1), F.lit(""))
    return mutable, F.coalesce(age.cast("bigint"), F.lit(DEFAULT_MAX_AGE).cast("bigint"))


def next_nodes(frontier: DataFrame, n: int = 1) -> DataFrame:
    """The n nodes to visit next of a frontier (url, status, earliest_next_visit).

    Immutable pages with members left come first, then pages not visited, then mutable ones by
    their next visit; finished immutable pages are never visited.
    """
    rank = F.when(F.col("status") == "IMMUTABLE_WITH_UNPROCESSED_MEMBERS", 0).when(F.col("status") == "NOT_VISITED", 1).when(F.col("status") == "MUTABLE_AND_ACTIVE", 2)
    due = F.when(rank == 2, F.col("earliest_next_visit"))
    return frontier.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).orderBy("_rank", due.asc_nulls_first(), "url").limit(n).drop("_rank")


# the client


@dataclass
class Page:
    url: str
    status: int
    rows: list[tuple] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)
    mutable: bool = True
    max_age: int = DEFAULT_MAX_AGE
    etag: str | None = None

    def subjects(self) -> dict[str, list[tuple]]:
        out: dict[str, list[tuple]] = defaultdict(list)
        for r in self.rows:
            out[r[1]].append(r)
        return out

    def members(self, timestamp_path: str | None = None) -> list[tuple[str, str | None, list[tuple]]]:
        """(id, time, statements) of each member, by time."""
        by_subject, out = self.subjects(), []
        for m in dict.fromkeys(r[4] for r in self.rows if r[3] == TREE + "member"):
            seen, todo, rows = {m}, [m], []
            while todo:
                for r in by_subject.get(todo.pop(), []):
                    if r[3] in (TREE + "member", TREE + "relation", TREE + "view"):
                        continue
                    rows.append(r)
                    if r[5] != "literal" and r[4] not in seen:
                        seen.add(r[4])
                        todo.append(r[4])
            time = next((r[4] for r in by_subject.get(m, []) if r[3] == timestamp_path), None)
            out.append((m, time, rows))
        return sorted(out, key=lambda x: (x[1] or "", x[0]))


def cache_control(header: str | None) -> tuple[bool, int]:
    parts = (header or "").split(", ")
    age = next((p.split("=")[1] for p in parts if p.startswith("max-age=")), None)
    return "immutable" not in (header or ""), int(age) if age and age.isdigit() else DEFAULT_MAX_AGE


def fetch_page(execute: Executor, url: str, mime_type: str = "application/n-quads", etag: str | None = None) -> Page:
    """One page. A redirect is a page with one relation, 304 an empty page; other failures raise."""
    got: Response = execute(Request(url, headers={"Accept": mime_type} | ({"If-None-Match": etag} if etag else {})))
    mutable, age = cache_control(got.header("Cache-Control"))
    if (target := got.redirect()) is not None:
        return Page(url, got.status, relations=[target], mutable=False, max_age=age)
    if got.status == 304:
        return Page(url, 304, mutable=mutable, max_age=age, etag=etag)
    if got.status != 200:
        raise OSError(f"{url} answered {got.status}")
    rows = parse(got.body.decode(), (got.header("Content-Type") or mime_type), base=url)
    links = {r[4] for r in rows if r[3] == TREE + "relation"}
    targets = [r[4] for r in rows if r[3] == TREE + "node" and r[1] in links]
    return Page(url, 200, rows, list(dict.fromkeys(targets)), mutable, age, got.header("ETag"))


def starting_node(execute: Executor, url: str, mime_type: str = "application/n-quads") -> str:
    """The first node to visit: the object of tree:view, else the tree:Node itself."""
    got = follow_redirects(execute, Request(url, headers={"Accept": mime_type}))
    if got.status != 200:
        raise OSError(f"{url} answered {got.status}")
    rows = parse(got.body.decode(), got.header("Content-Type") or mime_type, base=got.url)
    views = sorted(r[4] for r in rows if r[3] == TREE + "view")
    nodes = sorted(r[1] for r in rows if r[3] == RDF_TYPE and r[4] == TREE + "Node")
    if got.url in nodes or got.url in views:
        return got.url
    if views or nodes:
        return (views or nodes)[0]
    raise ValueError(f"no starting node at {url}")


def stream_properties(execute: Executor, url: str, mime_type: str = "application/n-quads", hops: int = 1) -> dict[str, str]:
    """timestampPath, versionOfPath and shape of the event stream; a page leads there by dcterms:isPartOf."""
    got = follow_redirects(execute, Request(url, headers={"Accept": mime_type}))
    rows = parse(got.body.decode(), got.header("Content-Type") or mime_type, base=got.url)
    streams = [r[1] for r in rows if r[3] == RDF_TYPE and r[4] == LDES + "EventStream"]
    if streams:
        found = {r[3].removeprefix(LDES): r[4] for r in rows if r[1] == streams[0] and r[3] in (LDES + PROPERTIES[0], LDES + PROPERTIES[1])}
        shape = next((r[4] for r in rows if r[1] == streams[0] and r[3] == TREE + "shape"), None)
        return {"uri": streams[0]} | found | ({"shape": shape} if shape else {})
    parent = next((r[4] for r in rows if r[3] == DCT + "isPartOf"), None)
    if parent and hops:
        return stream_properties(execute, parent, mime_type, hops - 1)
    raise ValueError(f"no event stream at {url}")


@dataclass
class Frontier:
    """What is known of each node; serialises to the offset of a stream."""

    nodes: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.fresh = deque(u for u, n in self.nodes.items() if n["status"] == "NOT_VISITED")
        self.waiting = [(n["next"], u) for u, n in self.nodes.items() if n["status"] == "MUTABLE_AND_ACTIVE"]
        heapq.heapify(self.waiting)

    def add(self, url: str) -> None:
        if url not in self.nodes:
            self.nodes[url] = {"status": "NOT_VISITED", "next": 0.0, "received": [], "etag": None}
            self.fresh.append(url)

    def due(self, now: float) -> str | None:
        """The next node: one not visited, else a mutable one whose time has come."""
        while self.fresh:
            if self.nodes[self.fresh[0]]["status"] == "NOT_VISITED":
                return self.fresh[0]
            self.fresh.popleft()
        while self.waiting:
            time_, url = self.waiting[0]
            node = self.nodes[url]
            if node["status"] == "MUTABLE_AND_ACTIVE" and node["next"] == time_:
                return url if time_ <= now else None
            heapq.heappop(self.waiting)  # visited since
        return None

    def ended(self) -> bool:
        return all(n["status"] == "IMMUTABLE" for n in self.nodes.values())

    def visited(self, page: Page, now: float, timestamp_path: str | None = None) -> list[tuple]:
        """Record a page; gives its members not received before. An immutable page forgets their ids."""
        node = self.nodes[page.url]
        for r in page.relations:
            self.add(r)
        known = set(node["received"])
        fresh = [m for m in page.members(timestamp_path) if m[0] not in known]
        if page.mutable:
            node.update(status="MUTABLE_AND_ACTIVE", next=now + page.max_age, received=sorted(known | {m[0] for m in fresh}), etag=page.etag)
            heapq.heappush(self.waiting, (node["next"], page.url))
        else:
            node.update(status="IMMUTABLE", received=[], etag=None)
        return fresh


_SCHEMA = ", ".join(["member_id string", "created_at string", "page string", *[f"{c} string" for c in COLUMNS]])


def _rows(page: Page, found: list[tuple]) -> Iterator[tuple]:
    for member, time, rows in found:
        for r in rows:
            yield (member, time, page.url, member, *r)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(None)
        self.urls = urls


def timestamp_path(execute: Executor, options: Mapping[str, str]) -> str | None:
    """The option of that name; ``auto`` takes what the event stream says of itself."""
    path = options.get("timestamp-path")
    if path != "auto":
        return path
    return stream_properties(execute, options["urls"].split(",")[0].strip(), options.get("source-format", "application/n-quads")).get("timestampPath")


def client_status(offset: Mapping[str, str]) -> str:
    """What the client does, by a stream's offset: it replicates until every node has been visited once,
    then synchronises, and is done when no node can change any more."""
    states = {n["status"] for n in json.loads(offset["frontier"]).values()}
    return "REPLICATING" if "NOT_VISITED" in states else "SYNCHRONISING" if "MUTABLE_AND_ACTIVE" in states else "COMPLETED"


class LdesReader(DataSourceReader):
    """Batch: the driver follows relations to find the pages, some at a time; executors fetch them again and give their members."""

    def __init__(self, options: dict[str, str]):
        self.options, self.path = options, options.get("timestamp-path")

    def pages(self) -> list[str]:
        """Every page that relations lead to, found level by level with the requests of a level side by side."""
        execute = executor_from(self.options)
        mime = self.options.get("source-format", "application/n-quads")
        level = list(dict.fromkeys(starting_node(execute, u.strip(), mime) for u in self.options["urls"].split(",")))
        seen, known = [], set(level)
        with ThreadPoolExecutor(max(1, int(self.options.get("crawl-threads", 8)))) as pool:
            while level:
                found = list(pool.map(lambda u: fetch_page(execute, u, mime), level))
                seen += [p.url for p in found if p.status == 200]
                level = [r for r in dict.fromkeys(r for p in found for r in p.relations) if r not in known]
                known.update(level)
        return seen

    def partitions(self) -> list[InputPartition]:
        self.path = timestamp_path(executor_from(self.options), self.options)
        urls, size = self.pages(), max(1, int(self.options.get("pages-per-task", 16)))
        if limited(self.options):
            size = max(1, len(urls))
        return [_Urls(urls[i : i + size]) for i in range(0, len(urls), size)] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        execute = executor_from(self.options)
        for url in partition.urls:
            page = fetch_page(execute, url, self.options.get("source-format", "application/n-quads"))
            yield from _rows(page, page.members(self.path))


class LdesStream(SimpleDataSourceStreamReader):
    """Stream: each read visits the nodes that are due; the offset is the frontier, so a restart resumes.

    With the option ``spool`` a restart gives a batch that wasn't finished the rows that were read
    for it; without, its pages are fetched again.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.clock, self.spool = options, time.time, Spool(options.get("spool"))

    def initialOffset(self) -> dict:
        execute = executor_from(self.options)
        f = Frontier()
        for u in self.options["urls"].split(","):
            f.add(starting_node(execute, u.strip(), self.options.get("source-format", "application/n-quads")))
        return {"n": 0, "frontier": json.dumps(f.nodes)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if (kept := self.spool.get(start["n"])) is not None:
            return iter(kept[0]), kept[1]
        execute, f = executor_from(self.options), Frontier(json.loads(start["frontier"]))
        limit, rows, visits, path = int(self.options.get("pages-per-batch", 32)), [], 0, timestamp_path(execute, self.options)
        while visits < limit and (url := f.due(self.clock())) is not None:
            page = fetch_page(execute, url, self.options.get("source-format", "application/n-quads"), f.nodes[url]["etag"])
            rows += _rows(page, f.visited(page, self.clock(), path))
            visits += 1
        if not visits:
            return iter(()), start
        end = {"n": start["n"] + 1, "frontier": json.dumps(f.nodes)}
        self.spool.put(start["n"], rows, end)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.spool.between(start["n"], end["n"])) if self.spool else self.read(start)[0]

    def commit(self, end: dict) -> None:
        self.spool.drop_before(end["n"])


class LdesDataSource(DataSource):
    """``spark.read.format("ldes")`` and ``spark.readStream.format("ldes")``.

    Options: urls (comma-separated), source-format (mime type), timestamp-path (a predicate or ``auto``), pages-per-task,
    crawl-threads, pages-per-batch, spool, and the options of the HTTP executor.
    """

    @classmethod
    def name(cls) -> str:
        return "ldes"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LdesReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LdesStream(dict(self.options))


# the structure of a stream


def discover(execute: Executor, url: str, mime_type: str = "application/n-quads") -> tuple[str, list[tuple[str, str, bool]]]:
    """(root, edges): the relation tree below a start; an edge is (parent, child, required).

    Below the root level only relations with a tree:path are followed. A node is entered once.
    """
    root = starting_node(execute, url, mime_type)
    edges, seen, todo = [], {root}, [(root, 0)]
    while todo:
        here, depth = todo.pop(0)
        page = fetch_page(execute, here, mime_type)
        by = page.subjects()
        for r in [r for r in page.rows if r[3] == TREE + "relation"]:
            own = {x[3]: x[4] for x in by.get(r[4], [])}
            target, required = own.get(TREE + "node"), TREE + "path" in own
            if target is None or (depth > 0 and not required) or target in seen:
                continue
            seen.add(target)
            edges.append((here, target, required))
            todo.append((target, depth + 1))
    return root, edges


def structure_text(root: str, edges: list[tuple[str, str, bool]]) -> str:
    """The tree, one node a line."""
    children: dict[str, list[str]] = defaultdict(list)
    for parent, child, _ in edges:
        children[parent].append(child)
    lines = [root]

    def walk(node: str, lead: str) -> None:
        below = sorted(children[node])
        for i, child in enumerate(below):
            lines.append(f"{lead}+- {child}")
            walk(child, lead + ("|  " if i < len(below) - 1 else "   "))

    walk(root, "")
    return "\n".join(lines) + "\n"


def structure_counts(edges: DataFrame) -> DataFrame:
    """(parent, direct, total): children and all descendants of each node of an edge table (parent, child)."""
    e = edges.select(F.lit("").alias("model_id"), F.col("parent").alias("src"), F.col("child").alias("dst"))
    below = reach(e, e.select("model_id", F.col("src").alias("start"))).where("depth > 0")
    total = below.groupBy(F.col("start").alias("parent")).agg(F.count("*").alias("total"))
    direct = edges.groupBy("parent").agg(F.count_distinct("child").alias("direct"))
    return direct.join(total, "parent")
