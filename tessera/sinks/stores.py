"""Outputs that store models: file archives, tables, SPARQL endpoints, repositories, blobs, messages."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.operators.closure import subgraph
from tessera.operators.quads import COLUMNS, as_set, nquads_line, union
from tessera.operators.versions import timestamps
from tessera.plans import sparql
from tessera.sinks.text import EXTENSIONS, serialise
from tessera.sources.http import Request, executor_from, limited

# paths and names


def archive_path(ts: Column, collision: Column, extension: str = "ttl") -> Column:
    """yyyy/MM/dd/yyyy-MM-dd-HH-mm-ss-nnnnnnnnn[-n].ext of a wall-clock time; n counts models of the same time from 1."""
    stamp = F.date_format(ts, "yyyy-MM-dd-HH-mm-ss-SSSSSSSSS")
    suffix = F.when(collision > 0, F.concat(F.lit("-"), collision.cast("string"))).otherwise("")
    return F.concat(F.date_format(ts, "yyyy/MM/dd/"), stamp, suffix, F.lit(f".{extension}"))


def with_archive_paths(models: DataFrame, ts: str = "ts", key: str = "model_id", extension: str = "ttl") -> DataFrame:
    """``models`` with ``path``; of models of one time the least key comes first."""
    n = F.row_number().over(W.partitionBy(ts).orderBy(key)) - 1
    return models.withColumn("path", archive_path(F.col(ts), n, extension))


def blob_name(member_id: Column, extension: str) -> Column:
    return F.replace(F.concat(member_id, F.lit(f".{extension}")), F.lit("/"), F.lit("_"))


def write_files(named: DataFrame, root: str, write: Callable[[str, bytes], None] | None = None) -> int:
    """Write (path, content) rows below ``root`` from the executors; ``root`` must be storage they share."""

    def local(path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.part"
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, path)

    put = write or local

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put(f"{root.rstrip('/')}/{path}", content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return named.select("path", "content").transform(map_batches, run, "n long").agg(F.sum("n")).first()[0] or 0


def archive_out(quads: DataFrame, root: str, timestamp_path: str, mime_type: str = "text/turtle") -> int:
    """Each model as a file named by its time; gives the number of files."""
    texts = serialise(quads, mime_type).join(timestamps(quads, timestamp_path), "model_id")
    return write_files(with_archive_paths(texts, extension=EXTENSIONS[mime_type]), root)


def blob_out(quads: DataFrame, container: str, mime_type: str = "text/turtle", frame: Mapping | None = None, write: Callable[[str, bytes], None] | None = None) -> int:
    """Each model as a blob named by its member's id; ``write`` puts a blob, by default as a file."""
    texts = serialise(quads, mime_type, frame=frame)
    return write_files(texts.select(blob_name(F.col("model_id"), EXTENSIONS[mime_type]).alias("path"), "content"), container, write)


# tables


def select_rows(quads: DataFrame, query: str, types: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a SELECT for a table: xsd types become Spark types by ``types``; zoned times keep their offset.

    Without ``types`` every column is text. The columns are those of the query, so a table's schema is fixed.
    """
    found = sparql.select(quads, query)
    cols = [c for c in found.columns if c != "model_id"]
    cast = lambda c: F.col(f"`{c}`")["v"].try_cast(types[c]) if types and c in types else F.col(f"`{c}`")["v"]
    return found.select(*[cast(c).alias(c) for c in cols])


#: Characters of a key of text in the table that rows are taken from.
KEY_LENGTH = 4000


def rdb_out(rows: DataFrame, url: str, table: str, properties: Mapping[str, str], ignore_duplicates: bool = False, keys: Sequence[str] = (), batch_size: int = 1000) -> None:
    """Append rows by JDBC. With ``ignore_duplicates`` rows whose ``keys`` are in the table, or repeat, are left out.

    The executors then write a table of their own, from which one statement in the database takes
    what is new: nothing of the target is read here, and the database decides what is there.
    """
    if not ignore_duplicates:
        rows.write.option("batchsize", batch_size).jdbc(url, table, "append", dict(properties))
        return
    staged = f"{table}_new_{uuid.uuid4().hex[:12]}"
    # as text of any length, keys couldn't be compared in some databases
    comparable = ", ".join(f"`{k}` VARCHAR({KEY_LENGTH})" for k, kind in rows.dtypes if k in keys and kind == "string")
    fresh = rows.dropDuplicates(list(keys) or None).write.option("batchsize", batch_size)
    (fresh.option("createTableColumnTypes", comparable) if comparable else fresh).jdbc(url, staged, "overwrite", dict(properties))
    try:
        _execute(rows.sparkSession, url, properties, insert_sql(table, rows.columns, staged, keys))
    finally:
        _execute(rows.sparkSession, url, properties, f"DROP TABLE {staged}")


def insert_sql(table: str, columns: Sequence[str], staged: str, keys: Sequence[str] = ()) -> str:
    """Take the rows of ``staged`` whose keys ``table`` lacks, or those that break none of its constraints if no keys are named."""
    quoted = lambda c: f'"{c}"'
    names = ", ".join(map(quoted, columns))
    head = f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged} fresh"
    if not keys:
        return f"{head} ON CONFLICT DO NOTHING"
    same = " AND ".join(f"there.{quoted(k)} = fresh.{quoted(k)}" for k in keys)
    return f"{head} WHERE NOT EXISTS (SELECT 1 FROM {table} there WHERE {same})"


def _execute(spark: SparkSession, url: str, properties: Mapping[str, str], sql: str) -> None:
    """One statement over a connection of the driver."""
    jvm = spark.sparkContext._jvm
    if driver := properties.get("driver"):
        jvm.java.lang.Class.forName(driver)
    own = jvm.java.util.Properties()
    for k, v in properties.items():
        own.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        statement = connection.createStatement()
        statement.execute(sql)
        statement.close()
    finally:
        connection.close()


# SPARQL endpoints


def delete_where(depth: int | None = 10, graph: str | None = None) -> str | None:
    """A DELETE, with %s for the subjects, of all that they say and all that nodes up to ``depth`` steps below say.

    One step is any predicate or none, so ``depth`` such steps reach every node up to there.
    """
    if depth is None:
        return None
    if depth < 0:
        raise ValueError(f"a deletion can't go {depth} steps deep")
    steps = "/".join(["(a|!a)?"] * depth)
    reach = f"?root {steps} ?node" if steps else "BIND(?root AS ?node)"
    scope = f"WITH <{graph}> " if graph else ""
    return f"{scope}DELETE {{ ?node ?property ?value }} WHERE {{ VALUES ?root {{ %s }} {reach} . ?node ?property ?value }}"


def update_text(quads: DataFrame, delete: str | None, graph: str | None = None, separator: str = " ") -> DataFrame:
    """(model_id, content): one update for each model, its deletion before its insertion."""
    subjects = F.array_join(F.array_sort(F.collect_set(F.when(F.col("s_kind") == "iri", F.concat(F.lit("<"), F.col("s"), F.lit(">"))))), separator)
    lines = F.array_join(F.array_sort(F.collect_set(nquads_line())), "\n")
    parts = [] if delete is None else [F.lit(delete.partition("%s")[0]), F.col("subjects"), F.lit(delete.partition("%s")[2] + " ;\n")]
    opening, closing = (f"GRAPH <{graph}> {{ ", " }") if graph else ("", "")
    grouped = quads.where(F.col("g").isNull()).groupBy("model_id").agg(subjects.alias("subjects"), lines.alias("lines"))
    return grouped.select("model_id", F.concat(*parts, F.lit(f"INSERT DATA {{ {opening}"), F.col("lines"), F.lit(f"{closing} }}")).alias("content"))


# HTTP and messages


def http_out(contents: DataFrame, url: str, mime_type: str, options: Mapping[str, str] | None = None, continue_on_fail: bool = True) -> DataFrame:
    """POST each (model_id, content); gives (model_id, status), -1 for no answer. Empty contents are skipped.
    With a rate limit one task sends them all."""
    chosen = dict(options or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        execute = executor_from(chosen)
        for batch in batches:
            done = []
            for m, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not content or not content.strip():
                    continue
                try:
                    status = execute(Request(url, "POST", {"Content-Type": mime_type}, content.encode())).status
                except OSError:
                    status = -1
                if not 200 <= status < 300 and not continue_on_fail:
                    raise OSError(f"{url} answered {status} for {m}")
                done.append((m, status))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=["model_id", "status"])

    sent = contents.select("model_id", "content")
    return (sent.coalesce(1) if limited(chosen) else sent).transform(map_batches, run, "model_id string, status int")


def kafka_rows(contents: DataFrame, mime_type: str, quads: DataFrame | None = None, key_path: str | None = None) -> DataFrame:
    """Rows for ``write.format("kafka")``: value, key by property path, and a content-type header."""
    out = contents.select("model_id", F.col("content").alias("value"), F.array(F.struct(F.lit("content-type").alias("key"), F.lit(mime_type).cast("binary").alias("value"))).alias("headers"))
    if key_path is None or quads is None:
        return out.drop("model_id")
    keys = sparql.property_path(quads, key_path).groupBy("model_id").agg(F.min("object.v").alias("key"))
    return out.join(keys, "model_id", "left").drop("model_id")


#: Senders to message queues by name: options to a call that takes a content and its type. They run on the executors.
SENDERS: dict[str, Callable[[Mapping[str, str]], Callable[[str, str], None]]] = {}


def sender(name: str | None, options: Mapping[str, str]) -> Callable[[str, str], None]:
    if name is None and len(SENDERS) == 1:
        name = next(iter(SENDERS))
    if name not in SENDERS:
        raise ValueError(f"no queue client {name!r} is registered; known: {', '.join(sorted(SENDERS)) or 'none'}")
    return SENDERS[name](options)


def queue_out(contents: DataFrame, send: Callable[[str, str], None], mime_type: str) -> int:
    """Give each content to ``send(content, content type)`` on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                send(content, mime_type)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return contents.select("content").transform(map_batches, run, "n long").agg(F.sum("n")).first()[0] or 0


# repositories


def replaced(store: DataFrame, batch: DataFrame, skolem: str = "/.well-known/genid/") -> DataFrame:
    """(s): the subjects of ``store`` whose statements a batch replaces: the batch's named subjects, and the
    blank and skolem nodes below those. The store is one graph."""
    everything = store.withColumn("model_id", F.lit(""))
    subjects = batch.where((F.col("s_kind") == "iri") & ~F.contains("s", F.lit(skolem))).select(F.lit("").alias("model_id"), F.col("s").alias("root")).distinct()
    nested = (F.col("o_kind") == "bnode") | F.contains("o", F.lit(skolem))
    return subgraph(everything, subjects, nested).select("s").distinct()


def upsert(store: DataFrame, quads: DataFrame, skolem: str = "/.well-known/genid/", graph: str | None = None) -> DataFrame:
    """The store after a batch, which takes the place of all that ``replaced`` names; ``model_id`` stays that of each row."""
    batch = quads.withColumn("g", F.lit(graph).cast("string")) if graph else quads
    return as_set(union(store.join(replaced(store, batch, skolem), "s", "left_anti").select(*COLUMNS), batch))
