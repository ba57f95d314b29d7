"""Messages as rows of (model_id, content, mime_type): files, topics, queues and polled URLs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessera.sources.http import Request, executor_from
from tessera.sources.schedule import Cron
from tessera.sources.spool import Spool

MIME_BY_EXTENSION = {"nq": "application/n-quads", "nt": "application/n-triples", "ttl": "text/turtle", "trig": "application/trig", "jsonld": "application/ld+json", "json": "application/json"}


def _mime(path, default: str | None):
    if default:
        return F.lit(default)
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for e, m in MIME_BY_EXTENSION.items():
        out = out.when(extension == e, m)
    return out.otherwise("application/n-quads")


def archive(spark: SparkSession, root: str, mime_type: str | None = None) -> DataFrame:
    """Every file below ``root`` as a message with ``position``, its place in the order of a depth-first
    walk with names in lexical order. The type is guessed by the extension unless given."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # directories sort as their names, so comparing the parts of the paths gives the walk's order
    order = F.split("path", "/")
    return files.select(F.col("path").alias("model_id"), F.col("value").alias("content"), _mime(F.col("path"), mime_type).alias("mime_type"), order.alias("position"))


def archive_stream(spark: SparkSession, root: str, mime_type: str | None = None, files_per_batch: int = 500) -> DataFrame:
    """New files below ``root`` as they arrive; also the landing folder of pushed HTTP messages."""
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    path = F.col("_metadata.file_path")
    return reader.load(root).select(path.alias("model_id"), F.col("value").alias("content"), _mime(path, mime_type).alias("mime_type"))


def kafka_stream(spark: SparkSession, servers: str, topics: str, mime_type: str = "application/n-quads", offset_reset: str = "earliest", group: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Records of comma-separated topics; the content-type header has the mime type. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", offset_reset).option("includeHeaders", True)
    if group:
        reader = reader.option("kafka.group.id", group)
    return kafka_messages(reader.options(**(options or {})).load(), mime_type)


def kafka_messages(records: DataFrame, mime_type: str = "application/n-quads") -> DataFrame:
    """Messages of Kafka rows (topic, partition, offset, value, headers)."""
    header = F.get(F.filter("headers", lambda h: F.lower(h["key"]) == "content-type"), F.lit(0))["value"].cast("string")
    name = F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return records.select(name.alias("model_id"), F.col("value").cast("string").alias("content"), F.coalesce(header, F.lit(mime_type)).alias("mime_type"))


class HttpPoll(SimpleDataSourceStreamReader):
    """Each trigger requests every URL once, or with ``cron`` when its time has come.

    The offset counts the rounds. With the option ``spool`` a restart gives the answers that were
    read; without it, the URLs are requested again.
    """

    def __init__(self, options: dict[str, str], clock: Callable[[], datetime] = datetime.now):
        self.options, self.clock, self.spool = options, clock, Spool(options.get("spool"))
        self.cron = Cron(options["cron"]) if options.get("cron") else None
        self.due = self.cron.after(clock()) if self.cron else None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        if (kept := self.spool.get(n)) is not None:
            return iter(kept[0]), kept[1]
        if self.cron and self.clock() < self.due:
            return iter(()), start
        rows, end = self.poll(n), {"n": n + 1}
        if self.cron:
            self.due = self.cron.after(self.clock())
        self.spool.put(n, rows, end)
        return iter(rows), end

    def poll(self, n: int) -> list[tuple]:
        execute, rows = executor_from(self.options), []
        keep_on = self.options.get("continue-on-fail", "true").lower() == "true"
        for i, url in enumerate(self.options["urls"].split(",")):
            try:
                got = execute(Request(url.strip()))
                if not 200 <= got.status < 300:
                    raise OSError(f"{url} answered {got.status}")
                rows.append((f"{n}-{i}", got.body.decode(), got.header("Content-Type") or "application/n-quads"))
            except OSError:
                if not keep_on:
                    raise
        return rows

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if self.spool:
            return iter(self.spool.between(start["n"], end["n"]))
        return iter([r for n in range(start["n"], end["n"]) for r in self.poll(n)])

    def commit(self, end: dict) -> None:
        self.spool.drop_before(end["n"])


class HttpPollSource(DataSource):
    """``spark.readStream.format("http-poll")``: urls, continue-on-fail, cron, spool, and the options of the HTTP executor.

    Without ``cron`` the trigger's interval is the polling interval.
    """

    @classmethod
    def name(cls) -> str:
        return "http-poll"

    def schema(self) -> str:
        return "model_id string, content string, mime_type string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return HttpPoll(dict(self.options))


class QueueReader(SimpleDataSourceStreamReader):
    """Messages of a queue client registered under the option ``client``: a call that gives (body, content type) pairs.

    A queue gives a message once, so what was taken is kept in the folder ``spool`` until its
    micro-batch is done; a restart reads it there.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.spool = options, Spool(options.get("spool"))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if (kept := self.spool.get(start["n"])) is not None:
            return iter(kept[0]), kept[1]
        got = QUEUE_CLIENTS[self.options["client"]](self.options)
        default = self.options.get("source-format", "application/n-quads")
        rows = [(f"{self.options.get('queue', 'queue')}-{start['n'] + i}", body, kind or default) for i, (body, kind) in enumerate(got)]
        end = {"n": start["n"] + len(rows)}
        if rows:
            self.spool.put(start["n"], rows, end)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.spool.between(start["n"], end["n"]))

    def commit(self, end: dict) -> None:
        self.spool.drop_before(end["n"])


#: Clients of message queues by name: options to a list of (body, content type or None).
QUEUE_CLIENTS: dict = {}


class QueueSource(DataSource):
    """``spark.readStream.format("queue")``: options client, queue, source-format, spool."""

    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return "model_id string, content string, mime_type string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return QueueReader(dict(self.options))
