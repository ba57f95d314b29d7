"""Pipelines by configuration: one input, an optional adapter, transformers, and outputs.

Component settings are flat: nested keys are joined by dots and lists numbered; keys are found
whatever their case and without regard to - and _.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import enrich, geojson, versions
from tessera.operators.canonical import member_hashes
from tessera.plans import rml, sparql
from tessera.sinks import stores, text
from tessera.sinks.repository import Repository
from tessera.sources import json_adapters, ldes, messages, rdf_text
from tessera.sources.contexts import CAPACITY, RemoteContexts
from tessera.sources.http import limited
from tessera.sources.schedule import trigger_interval
from tessera.streaming import state_table
from tessera.streaming.state_table import StateTable

NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")


def flatten(value: Any, prefix: str = "") -> dict[str, str]:
    if isinstance(value, Mapping):
        return {k: v for key, x in value.items() for k, v in flatten(x, f"{prefix}.{key}" if prefix else str(key)).items()}
    if isinstance(value, list):
        return {k: v for i, x in enumerate(value) for k, v in flatten(x, f"{prefix}.{i}").items()}
    return {prefix: "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)}


class Settings:
    def __init__(self, values: Mapping[str, Any] | None = None):
        flat = flatten(values or {})
        self.batch: int | None = None
        self.values = flat
        self.index = {self.plain(k): v for k, v in flat.items()}

    @staticmethod
    def plain(key: str) -> str:
        return key.lower().replace("-", "").replace("_", "")

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.index.get(self.plain(key), default)

    def need(self, key: str) -> str:
        if (found := self.get(key)) is None:
            raise ValueError(f"missing setting {key}")
        return found

    def flag(self, key: str, default: bool = False) -> bool:
        found = self.get(key)
        return default if found is None else found.lower() == "true"

    def number(self, key: str, default: int) -> int:
        return int(self.get(key, str(default)))

    def list(self, key: str) -> list[str]:
        if (single := self.get(key)) is not None:
            return [single]
        out = []
        while (x := self.get(f"{key}.{len(out)}")) is not None:
            out.append(x)
        return out

    def below(self, prefix: str) -> dict[str, str]:
        start = self.plain(prefix) + "."
        return {k[len(start) :]: v for k, v in self.index.items() if k.startswith(start)}

    def text(self, key: str) -> str:
        """The setting's text, or that of the file it names."""
        value = self.need(key)
        if "\n" not in value and os.path.isfile(value):
            with open(value, encoding="utf-8") as f:
                return f.read()
        return value


def resolve(value: Any, environment: Mapping[str, str]) -> Any:
    """${name} and ${name:default} in every text."""
    if isinstance(value, Mapping):
        return {k: resolve(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, environment) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        name, colon, default = m[1].partition(":")
        if name in environment:
            return environment[name]
        if not colon:
            raise ValueError(f"nothing is known for ${{{name}}}")
        return default

    return re.sub(r"\$\{([^}]*)\}", one, value)


# the registry

INPUTS: dict[str, Callable[[SparkSession, Settings, bool], DataFrame]] = {}
ADAPTERS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {}
TRANSFORMERS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {}
OUTPUTS: dict[str, Callable[[DataFrame, Settings], Any]] = {}


def component(registry: dict, name: str) -> Callable:
    def add(f: Callable) -> Callable:
        registry[name] = f
        return f

    return add


def find(registry: dict, name: str) -> Callable:
    """Components go by their name, with or without a namespace that ends in a colon or a dot."""
    short = re.split(r"[:.]", name)[-1]
    if short not in registry:
        raise ValueError(f"unknown component {name}; known: {', '.join(sorted(registry))}")
    return registry[short]


def catalog() -> dict[str, list[str]]:
    return {k: sorted(r) for k, r in (("inputs", INPUTS), ("adapters", ADAPTERS), ("transformers", TRANSFORMERS), ("outputs", OUTPUTS))}


@component(INPUTS, "ArchiveFileIn")
def _archive_in(spark: SparkSession, s: Settings, streaming: bool) -> DataFrame:
    read = messages.archive_stream if streaming else messages.archive
    return read(spark, s.need("archive-root-dir"), s.get("source-format"))


@component(INPUTS, "HttpIn")
def _http_in(spark: SparkSession, s: Settings, streaming: bool) -> DataFrame:
    """Messages land as files, written by whatever accepts the requests."""
    return (messages.archive_stream if streaming else messages.archive)(spark, s.need("landing-dir"), s.get("source-format"))


@component(INPUTS, "LdesClient")
def _ldes_in(spark: SparkSession, s: Settings, streaming: bool) -> DataFrame:
    spark.dataSource.register(ldes.LdesDataSource)
    member_filters(s)  # raises if the settings contradict each other
    options = s.values | {"urls": ",".join(s.list("urls")), "source-format": s.get("source-format", "application/n-quads")}
    if s.get("timestamp-path"):
        options["timestamp-path"] = s.need("timestamp-path")
    return (spark.readStream if streaming else spark.read).format("ldes").options(**options).load()


@component(INPUTS, "LdesClientConnector")
def _connector_in(spark: SparkSession, s: Settings, streaming: bool) -> DataFrame:
    return _ldes_in(spark, s, streaming)


@component(INPUTS, "HttpInPoller")
def _poll_in(spark: SparkSession, s: Settings, streaming: bool) -> DataFrame:
    spark.dataSource.register(messages.HttpPollSource)
    return spark.readStream.format("http-poll").options(**(s.values | {"urls": ",".join(s.list("url") or s.list("urls"))})).load()


@component(INPUTS, "KafkaIn")
def _kafka_in(spark: SparkSession, s: Settings, streaming: bool) -> DataFrame:
    return messages.kafka_stream(spark, s.need("bootstrap-servers"), s.need("topics"), s.get("content-type", "application/n-quads"), s.get("auto-offset-reset", "earliest"), s.get("group-id"))


@component(INPUTS, "AmqpIn")
def _amqp_in(spark: SparkSession, s: Settings, streaming: bool) -> DataFrame:
    spark.dataSource.register(messages.QueueSource)
    return spark.readStream.format("queue").options(**s.values).load()


@component(ADAPTERS, "RdfAdapter")
def _rdf(df: DataFrame, s: Settings) -> DataFrame:
    """Contexts that JSON-LD names are fetched and kept, max-jsonld-cache-capacity at once."""
    return rdf_text.adapt(df, RemoteContexts(s.values, s.number("max-jsonld-cache-capacity", CAPACITY)))


@component(ADAPTERS, "JsonToLdAdapter")
def _json(df: DataFrame, s: Settings) -> DataFrame:
    remote = RemoteContexts(s.values, s.number("max-jsonld-cache-capacity", CAPACITY))
    return json_adapters.json_to_ld(df, s.get("context") or s.need("core-context"), remote, force=s.flag("force-content-type"))


@component(ADAPTERS, "NgsiV2ToLdAdapter")
def _ngsi(df: DataFrame, s: Settings) -> DataFrame:
    return json_adapters.ngsi_v2_to_ld(df, s.get("data-identifier", "data"), s.need("core-context"), s.get("ld-context"))


@component(ADAPTERS, "RmlAdapter")
def _rml(df: DataFrame, s: Settings) -> DataFrame:
    return rml.apply_mapping(df, s.text("mapping"))


@component(TRANSFORMERS, "SparqlConstructTransformer")
def _construct(q: DataFrame, s: Settings) -> DataFrame:
    return sparql.construct(q, s.text("query"), infer=s.flag("infer") or s.flag("include-original"))


@component(TRANSFORMERS, "VersionObjectCreator")
def _version_object(q: DataFrame, s: Settings) -> DataFrame:
    path = s.get("date-observed-property")
    return versions.create_version_objects(q, s.list("member-type"), [path.strip("<>")] if path else [], s.get("delimiter", "/"), s.get("generatedAt-property", versions.GENERATED_AT), s.get("versionOf-property", versions.VERSION_OF))


@component(TRANSFORMERS, "VersionMaterialiser")
def _materialise(q: DataFrame, s: Settings) -> DataFrame:
    return versions.materialise_versions(q, s.get("versionOf-property", versions.VERSION_OF), s.flag("restrict-to-members"))


@component(TRANSFORMERS, "SkolemisationTransformer")
def _skolemise(q: DataFrame, s: Settings) -> DataFrame:
    return versions.skolemise(q, s.need("skolem-domain"))


@component(TRANSFORMERS, "GeoJsonToWktTransformer")
def _geojson(q: DataFrame, s: Settings) -> DataFrame:
    return geojson.geojson_to_wkt(q, s.flag("transform-to-rdf-wkt-enabled"))


@component(TRANSFORMERS, "HttpEnricher")
def _enriched(q: DataFrame, s: Settings) -> DataFrame:
    """Unite each model with what the URL at the end of a property path answers."""
    paths = {"body_path": s.get("body-property-path"), "header_path": s.get("header-property-path"), "method_path": s.get("http-method-property-path")}
    return enrich.http_enrich(q, enrich.fetcher(s.values), s.need("url-property-path"), limited(s.values), **paths)


@component(TRANSFORMERS, "ChangeDetectionFilter")
def _changed(q: DataFrame, s: Settings, state: StateTable | None = None) -> DataFrame:
    """Models whose member isn't as it was before; of one batch, in the order of model_id. On a stream the
    digests are remembered."""
    members = member_hashes(q)
    passed = versions.changed(members, arrival="model_id") if state is None else state_table.changed(members, state, s.batch)
    return q.join(passed.select("model_id"), "model_id", "left_semi").select(*q.columns)


#: Transformers that remember what earlier micro-batches held.
STATEFUL = ("ChangeDetectionFilter",)


def member_filters(s: Settings) -> list[str]:
    """The filters of members that an event stream's client is set to apply, in order."""
    choice = lambda key: s.flag(key) if s.get(key) is not None else None
    return versions.member_filters(choice("enable-exactly-once"), s.flag("materialisation.enabled"), choice("materialisation.enable-latest-state"))


def filtered(frame: DataFrame, s: Settings, state: Callable[[str], StateTable | None]) -> DataFrame:
    """Rows of the ``ldes`` source after those filters. Members of one batch come in the order of their times."""
    version_of = s.get("materialisation.version-of-property", versions.VERSION_OF)
    for name in member_filters(s):
        if name == "materialise":
            frame = versions.materialise_versions(frame, version_of, s.flag("materialisation.restrict-to-members"))
            continue
        arrival = F.struct("created_at", "member_id", "page")
        members = frame.groupBy("member_id", "created_at", "page").agg(F.min(F.when((F.col("p") == version_of) & (F.col("s") == F.col("member_id")), F.col("o"))).alias("entity"))
        members = members.withColumn("arrival_seq", arrival)
        known = state(name)
        if name == "exactly_once":
            passed = versions.exactly_once(members) if known is None else state_table.exactly_once(members, known, s.batch, arrival="arrival_seq")
        else:
            members = members.withColumns({"version_of": F.coalesce("entity", "member_id"), "ts": F.try_to_timestamp("created_at").cast("timestamp_ntz")})
            passed = versions.latest_state(members) if known is None else state_table.latest_state(members, known, s.batch, arrival="arrival_seq")
        frame = frame.join(passed.select("member_id", "page"), ["member_id", "page"], "left_semi").select(*frame.columns)
    return frame


@component(OUTPUTS, "ConsoleOut")
def _console(q: DataFrame, s: Settings) -> None:
    text.serialise(q, s.get("content-type", "text/turtle")).show(s.number("rows", 20), truncate=False)


@component(OUTPUTS, "NoopOut")
def _noop(q: DataFrame, s: Settings) -> None:
    q.write.format("noop").mode("overwrite").save()


@component(OUTPUTS, "FileOut")
def _files(q: DataFrame, s: Settings) -> int:
    return stores.archive_out(q, s.need("archive-root-dir"), s.need("timestamp-path"))


@component(OUTPUTS, "HttpOut")
def _http(q: DataFrame, s: Settings) -> int:
    mime = s.get("rdf-writer.content-type") or s.get("content-type", "text/turtle")
    return stores.http_out(text.serialise(q, mime), s.need("endpoint"), mime, s.values, s.flag("continue-on-fail", True)).count()


@component(OUTPUTS, "KafkaOut")
def _kafka(q: DataFrame, s: Settings) -> None:
    mime = s.get("content-type", "application/n-quads")
    stores.kafka_rows(text.serialise(q, mime), mime, q, s.get("key-property-path")).write.format("kafka").option("kafka.bootstrap.servers", s.need("bootstrap-servers")).option("topic", s.need("topic")).save()


@component(OUTPUTS, "AmqpOut")
def _queue(q: DataFrame, s: Settings) -> int:
    """Send each model with the client registered under the setting ``client``, else the only one there is."""
    mime = s.get("content-type", "application/n-quads")
    return stores.queue_out(text.serialise(q, mime), stores.sender(s.get("client"), s.values), mime)


@component(OUTPUTS, "RdbOut")
def _rdb(q: DataFrame, s: Settings) -> None:
    stores.rdb_out(stores.select_rows(q, s.text("sparql-select-query")), s.need("jdbc-url"), s.need("table-name"), s.below("jdbc-properties"), s.flag("ignore-duplicate-key-exception"), s.list("keys"))


@component(OUTPUTS, "HttpSparqlOut")
def _sparql_out(q: DataFrame, s: Settings) -> int:
    if s.get("skolemisation.skolem-domain"):
        q = versions.skolemise(q, s.need("skolemisation.skolem-domain"))
    delete = stores.delete_where(s.number("replacement.depth", 10), s.get("graph")) if s.flag("replacement.enabled", True) else None
    own = s.get("replacement.delete-function")  # lists its subjects with commas
    updates = stores.update_text(q, own or delete, s.get("graph"), ", " if own else " ")
    return stores.http_out(updates, s.need("endpoint"), "application/sparql-update", s.values, continue_on_fail=False).count()


@component(OUTPUTS, "RepositorySink")
def _repository(q: DataFrame, s: Settings) -> None:
    """Models replace what the repository in the folder ``path`` says of them: at once in a batch, and on a
    stream when batch-size models have come or the first has waited batch-timeout milliseconds."""
    into, graph = Repository(q.sparkSession, s.need("path")), s.get("named-graph")
    if s.batch is None:
        into.commit(q, graph)
    else:
        into.add(q, s.batch, s.number("batch-size", 500), s.number("batch-timeout", 120_000) / 1000, graph)


@component(OUTPUTS, "AzureBlobOut")
def _blob(q: DataFrame, s: Settings) -> int:
    return stores.blob_out(q, s.need("storage-container"), s.get("content-type", "text/turtle"))


class Status(Enum):
    INIT = "INIT"
    RUNNING = "RUNNING"
    HALTED = "HALTED"
    STOPPED = "STOPPED"


#: Which states may follow a state.
TRANSITIONS = {
    Status.INIT: (Status.RUNNING, Status.STOPPED),
    Status.RUNNING: (Status.HALTED, Status.STOPPED),
    Status.HALTED: (Status.RUNNING, Status.STOPPED),
    Status.STOPPED: (),
}


@dataclass
class Step:
    name: str
    config: dict = field(default_factory=dict)

    @property
    def settings(self) -> Settings:
        return Settings(self.config)


@dataclass
class Pipeline:
    name: str
    input: Step
    adapter: Step | None
    transformers: list[Step]
    outputs: list[Step]
    description: str = ""
    status: Status = Status.INIT
    query: StreamingQuery | None = None
    #: Messages that came in and statements that went out, of the last run or micro-batches so far.
    counts: dict[str, int] = field(default_factory=lambda: {"in": 0, "out": 0})

    @classmethod
    def parse(cls, raw: Mapping[str, Any], environment: Mapping[str, str] | None = None) -> Pipeline:
        raw = resolve(raw, environment if environment is not None else os.environ)
        name = raw.get("name", "")
        if not NAME.match(name):
            raise ValueError(f"not a pipeline name: {name!r}")
        step = lambda x: Step(x["name"], dict(x.get("config") or {}))
        source = raw.get("input")
        if not source or not raw.get("outputs"):
            raise ValueError("a pipeline needs an input and an output")
        adapter = step(source["adapter"]) if source.get("adapter") else None
        return cls(name, step(source), adapter, [step(x) for x in raw.get("transformers") or []], [step(x) for x in raw["outputs"]], raw.get("description", ""))

    def transform(self, frame: DataFrame, batch: int | None = None, state: str | None = None) -> DataFrame:
        """Input rows to the quads of the outputs; on a stream, filters remember in the folder ``state``."""

        def table(name: str) -> StateTable | None:
            return StateTable(frame.sparkSession, f"{state}/{name}") if state else None

        def settings(step: Step) -> Settings:
            s = step.settings
            s.batch = batch
            return s

        if "member_id" in frame.columns and re.split(r"[:.]", self.input.name)[-1].startswith("LdesClient"):
            frame = filtered(frame, settings(self.input), table)
        if self.adapter:
            frame = find(ADAPTERS, self.adapter.name)(frame, self.adapter.settings)
        for i, t in enumerate(self.transformers):
            run, remembers = find(TRANSFORMERS, t.name), re.split(r"[:.]", t.name)[-1] in STATEFUL
            frame = run(frame, settings(t), table(f"{i}-{t.name.replace(':', '-')}")) if remembers else run(frame, settings(t))
        return frame

    def emit(self, quads: DataFrame, batch: int | None = None) -> None:
        """All outputs of the same rows, which are computed once."""
        seen = Observation()
        held = quads.observe(seen, F.count(F.lit(1)).alias("out"))
        held = held.persist() if len(self.outputs) > 1 else held
        try:
            for o in self.outputs:
                s = o.settings
                s.batch = batch
                find(OUTPUTS, o.name)(held, s)
        finally:
            if len(self.outputs) > 1:
                held.unpersist()
        found = seen._jo.getOrEmpty()  # empty if the optimizer found that there is nothing to count
        self.counts["out"] += int(found.get("out").get()) if found.contains("out") else 0

    def move(self, to: Status) -> None:
        if to not in TRANSITIONS[self.status]:
            raise ValueError(f"{self.name} can't go from {self.status.value} to {to.value}")
        self.status = to

    def watch(self) -> Status:
        """The status now: a stream that ended by an error has halted, and can be resumed."""
        if self.status is Status.RUNNING and self.query is not None and not self.query.isActive and self.query.exception() is not None:
            self.status = Status.HALTED
        return self.status

    def client_status(self) -> str | None:
        """What an event stream's client does; None for other inputs or before the first micro-batch."""
        if self.query is None:
            return None
        if self.query.exception() is not None:
            return "ERROR"
        progress = self.query.lastProgress
        end = progress["sources"][0]["endOffset"] if progress and progress["sources"] else None
        end = json.loads(end) if isinstance(end, str) else end
        return ldes.client_status(end) if end and "frontier" in end else None

    def run(self, spark: SparkSession) -> None:
        """One batch over all input."""
        self.emit(self.transform(find(INPUTS, self.input.name)(spark, self.input.settings, False)))

    def start(self, spark: SparkSession, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Run on a stream; every micro-batch goes through the same chain. A restart resumes from ``checkpoint``,
        where filters also keep their state and sources what they have fetched. An error halts the pipeline."""
        self.watch()
        self.move(Status.RUNNING)
        given = Settings({"spool": f"{checkpoint.rstrip('/')}/spool"} | self.input.config)
        stream = find(INPUTS, self.input.name)(spark, given, True)

        def each(batch: DataFrame, number: int) -> None:
            came = Observation()
            self.emit(self.transform(batch.observe(came, F.count(F.lit(1)).alias("in")), number, f"{checkpoint.rstrip('/')}/state"), number)
            found = came._jo.getOrEmpty()
            self.counts["in"] += int(found.get("in").get()) if found.contains("in") else 0

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(self.name)
        interval = self.input.settings.get("interval")
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger_interval(interval)) if interval else writer
        self.query = writer.start()
        return self.query

    def halt(self) -> None:
        self.watch()
        if self.status is Status.HALTED:
            return
        self.move(Status.HALTED)
        if self.query:
            self.query.stop()

    def stop(self) -> None:
        self.move(Status.STOPPED)
        if self.query:
            self.query.stop()


def read_definition(path: str) -> dict:
    """A pipeline's definition from JSON, or from YAML where its parser is installed."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if path.endswith(".json"):
        return json.loads(body)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: YAML needs PyYAML; JSON can always be read") from e
    return yaml.safe_load(body)


class Manager:
    """The pipelines of one application, by name. With ``saved`` their definitions are kept as files,
    from which a later application starts."""

    def __init__(self, spark: SparkSession, checkpoints: str, saved: str | None = None):
        self.spark, self.checkpoints, self.saved, self.pipelines = spark, checkpoints, saved, {}

    def restore(self) -> list[str]:
        """Create the pipelines of the saved definitions; names that exist already are left alone."""
        made = []
        for file in sorted(os.listdir(self.saved)) if self.saved and os.path.isdir(self.saved) else []:
            raw = read_definition(os.path.join(self.saved, file))
            if raw.get("name") not in self.pipelines:
                made.append(self.create(raw, save=False).name)
        return made

    def create(self, raw: Mapping[str, Any], save: bool = True) -> Pipeline:
        p = Pipeline.parse(raw)
        if p.name in self.pipelines:
            raise ValueError(f"pipeline {p.name} exists")
        for registry, steps in ((INPUTS, [p.input]), (ADAPTERS, [p.adapter] if p.adapter else []), (TRANSFORMERS, p.transformers), (OUTPUTS, p.outputs)):
            for s in steps:
                find(registry, s.name)
        self.pipelines[p.name] = p
        if self.saved and save:
            os.makedirs(self.saved, exist_ok=True)
            with open(os.path.join(self.saved, f"{p.name}.json"), "w", encoding="utf-8") as f:
                json.dump(raw, f, indent=2)
        return p

    def start(self, name: str) -> StreamingQuery:
        return self.pipelines[name].start(self.spark, f"{self.checkpoints.rstrip('/')}/{name}")

    def halt(self, name: str) -> None:
        self.pipelines[name].halt()

    def resume(self, name: str) -> StreamingQuery:
        return self.start(name)

    def delete(self, name: str) -> bool:
        p = self.pipelines.pop(name, None)
        if p is None:
            return False
        if p.status is not Status.STOPPED:
            p.stop()
        if self.saved and os.path.exists(file := os.path.join(self.saved, f"{name}.json")):
            os.remove(file)
        return True

    def statuses(self) -> dict[str, str]:
        return {n: p.watch().value for n, p in self.pipelines.items()}

    def client_status(self, name: str) -> str | None:
        return self.pipelines[name].client_status()

    def counts(self, name: str) -> dict[str, int]:
        return dict(self.pipelines[name].counts)
