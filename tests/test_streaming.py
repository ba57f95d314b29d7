from datetime import datetime

import pandas as pd
import pytest

from tessera.operators import versions
from tessera.plans.pipeline import OUTPUTS, Manager, Pipeline, Settings, Status, catalog, component, filtered, find, member_filters, resolve
from tessera.sinks import stores, text
from tessera.sinks.repository import Repository
from tessera.operators.quads import SCHEMA
from tessera.sources import ldes
from tessera.streaming import state_table, stateful

SCHEMA_IN = "member_id long, version_of long, ts timestamp_ntz, arrival_seq long, hash string"


def arrivals(n=60):
    frame = pd.DataFrame({"arrival_seq": range(n)})
    frame["member_id"] = frame.arrival_seq * 7 % 11
    frame["version_of"] = frame.arrival_seq % 5
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(frame.arrival_seq * 37 % 23, unit="h")
    frame["hash"] = (frame.arrival_seq // 11 % 2).astype(str)
    return frame[["member_id", "version_of", "ts", "arrival_seq", "hash"]]


@pytest.mark.parametrize("name", ["latest_state", "changed", "exactly_once"])
def test_stream_equals_batch(spark, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frame = arrivals()
    for i in range(3):  # files are taken in the order of their names' times
        part = spark.createDataFrame(frame.iloc[i * 20 : (i + 1) * 20], SCHEMA_IN)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA_IN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = getattr(stateful, name)(stream)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r.arrival_seq for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = getattr(versions, name)(spark.createDataFrame(frame, SCHEMA_IN))
    assert got == {r.arrival_seq for r in batch.collect()}


def config(tmp_path, name="copy"):
    return {
        "name": name,
        "input": {"name": "Any:ArchiveFileIn", "config": {"archive-root-dir": str(tmp_path / "in")}, "adapter": {"name": "Any:RdfAdapter"}},
        "transformers": [
            {"name": "SparqlConstructTransformer", "config": {"query": "CONSTRUCT { ?s <http://e/renamed> ?o } WHERE { ?s <http://e/p> ?o }"}},
            {"name": "SkolemisationTransformer", "config": {"skolem-domain": "http://d"}},
        ],
        "outputs": [{"name": "RepositorySink", "config": {"path": str(tmp_path / "repo")}}, {"name": "NoopOut"}],
    }


def test_pipeline_in_batch_and_on_a_stream(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "a.nq").write_text('<http://e/a> <http://e/p> "1" .\n_:b <http://e/p> "2" .\n')
    Pipeline.parse(config(tmp_path)).run(spark)
    rows = Repository(spark, str(tmp_path / "repo")).read().collect()
    assert {(r.p, r.o) for r in rows} == {("http://e/renamed", "1"), ("http://e/renamed", "2")} and all(r.s_kind == "iri" for r in rows)
    p = Pipeline.parse(config(tmp_path))
    p.start(spark, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert p.query.exception() is None
    p.halt()
    assert p.status is Status.HALTED
    p.stop()
    with pytest.raises(ValueError):
        p.move(Status.RUNNING)


RAN = []


@component(OUTPUTS, "Seen")
def _seen(q, s):
    RAN.append(sorted(r.model_id.rpartition("/")[2] for r in q.select("model_id").distinct().collect()))


def test_changes_are_remembered_between_batches_and_over_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = {
        "name": "changes",
        "input": {"name": "ArchiveFileIn", "config": {"archive-root-dir": str(tmp_path / "in")}, "adapter": {"name": "RdfAdapter"}},
        "transformers": [{"name": "Any:ChangeDetectionFilter"}],
        "outputs": [{"name": "Seen"}],
    }
    RAN.clear()
    for n, value in enumerate(["1", "1", "2", "1"]):
        (tmp_path / "in" / f"{n}.nq").write_text(f'<http://e/a> <http://e/p> "{value}" .\n')
        p = Pipeline.parse(raw)  # each start is a restart from the checkpoint
        p.start(spark, str(tmp_path / "cp"), once=True).awaitTermination(120)
        assert p.query.exception() is None and p.counts["in"] == 1
    assert RAN == [["0.nq"], [], ["2.nq"], ["3.nq"]]


def test_state_tables_merge_and_replay(spark, tmp_path):
    state = state_table.StateTable(spark, str(tmp_path / "s"))
    ddl = "member_id string, version_of string, ts timestamp_ntz, arrival_seq long"
    for n in range(20):
        members = spark.createDataFrame([(f"m{n % 3}", "v", datetime(2024, 1, 1, n * 7 % 5), n)], ddl)
        for _ in range(2):  # run again as after a failure
            passed = state_table.exactly_once(members, state, n, arrival="arrival_seq").count()
            assert passed == (n < 3)
    assert len(state.tables(99)) < 20 and state.before(99, spark.createDataFrame([("m1",), ("x",)], "key string")).collect() == [("m1", "1")]
    later, best = state_table.StateTable(spark, str(tmp_path / "l")), None
    for n in range(6):
        hours = n * 7 % 5
        members = spark.createDataFrame([("m", "v", datetime(2024, 1, 1, hours), n)], ddl)
        assert state_table.latest_state(members, later, n, arrival="arrival_seq").count() == (best is None or hours > best)
        best = max(hours, best if best is not None else hours)


def member_rows(spark, rows):
    """Rows as the ldes source gives them: (member, entity, time)."""
    out = []
    for member, entity, time in rows:
        own = [("http://purl.org/dc/terms/isVersionOf", entity, "iri", None), ("http://e/t", time, "literal", None)]
        out += [(member, time, "http://page", member, None, member, "iri", p, o, k, dt, None) for p, o, k, dt in own]
    return spark.createDataFrame(out, ldes._SCHEMA)


def test_member_filters_of_the_client(spark, tmp_path):
    day = lambda n: f"2024-01-0{n}T00:00:00Z"
    batches = [[("http://e/a1", "http://e/a", day(1)), ("http://e/a3", "http://e/a", day(3))], [("http://e/a3", "http://e/a", day(3)), ("http://e/a2", "http://e/a", day(2)), ("http://e/a4", "http://e/a", day(4))]]

    def passed(config, name):
        out = []
        for n, rows in enumerate(batches):
            s = Settings(config)
            s.batch = n
            got = filtered(member_rows(spark, rows), s, lambda kind: state_table.StateTable(spark, str(tmp_path / name / kind)))
            out.append(sorted({(r.model_id, r.s) for r in got.collect()}))
        return out

    a = lambda n: f"http://e/a{n}"
    assert passed({}, "once") == [[(a(1), a(1)), (a(3), a(3))], [(a(2), a(2)), (a(4), a(4))]]
    assert passed({"enable-exactly-once": "false"}, "all") == [[(a(1), a(1)), (a(3), a(3))], [(a(2), a(2)), (a(3), a(3)), (a(4), a(4))]]
    latest = passed({"materialisation": {"enabled": "true"}}, "latest")
    assert latest == [[(a(1), "http://e/a"), (a(3), "http://e/a")], [(a(4), "http://e/a")]]
    with pytest.raises(ValueError):
        member_filters(Settings({"enable-exactly-once": "true", "materialisation.enabled": "true"}))


def test_an_error_halts_and_can_be_resumed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nq").write_text("broken\n")
    m = Manager(spark, str(tmp_path / "cp"))
    m.create({"name": "bad", "input": {"name": "ArchiveFileIn", "config": {"archive-root-dir": str(tmp_path / "in")}, "adapter": {"name": "RdfAdapter"}}, "outputs": [{"name": "NoopOut"}]})
    q = m.start("bad")
    with pytest.raises(Exception, match="not a statement"):
        q.awaitTermination(120)
    assert m.statuses() == {"bad": "HALTED"}
    (tmp_path / "in" / "a.nq").write_text("<a:a> <b:b> <c:c> .\n")
    again = m.resume("bad")
    again.processAllAvailable()
    assert m.statuses() == {"bad": "RUNNING"} and m.counts("bad") == {"in": 1, "out": 1}
    m.delete("bad")


def test_repository_waits_for_a_batch(spark, tmp_path):
    now = [1e12]
    repo = Repository(spark, str(tmp_path / "r"), lambda: now[0])
    model = lambda n, v: spark.createDataFrame([(f"m{n}", None, f"http://e/{n}", "iri", "http://e/p", v, "literal", None, None)], SCHEMA)
    now[0] = 0
    assert repo.add(model(1, "a"), 0, size=2, timeout=1e9) is None and repo.read().count() == 0
    assert repo.add(model(1, "a"), 0, size=2, timeout=1e9) is None  # the same micro-batch again
    assert repo.add(model(2, "b"), 1, size=2, timeout=1e9) == "v00000000" and repo.read().count() == 2
    assert repo.add(model(1, "c"), 2, size=9, timeout=1e9) is None
    now[0] = 1e12
    assert repo.add(model(3, "d"), 3, size=9) == "v00000001"
    assert sorted((r.s[-1], r.o) for r in repo.read().collect()) == [("1", "c"), ("2", "b"), ("3", "d")]
    assert sorted((r.s[-1], r.o) for r in stores.upsert(model(1, "a"), model(1, "z")).collect()) == [("1", "z")]


def test_settings_and_registry(spark, tmp_path):
    s = Settings({"auth": {"Api-Key": "k"}, "urls": ["a", "b"], "flag": True})
    assert s.get("AUTH.apikey") == "k" and s.list("urls") == ["a", "b"] and s.flag("flag")
    assert resolve({"a": ["${X:y}"]}, {}) == {"a": ["y"]} and resolve("${X}", {"X": "z"}) == "z"
    with pytest.raises(ValueError):
        resolve("${X}", {})
    m = Manager(spark, str(tmp_path))
    m.create(config(tmp_path))
    with pytest.raises(ValueError, match="exists"):
        m.create(config(tmp_path))
    with pytest.raises(ValueError, match="unknown component"):
        m.create(config(tmp_path, "other") | {"outputs": [{"name": "Nothing"}]})
    with pytest.raises(ValueError, match="name"):
        Pipeline.parse({"name": "-", "input": {"name": "x"}, "outputs": [{"name": "y"}]})
    kept = Manager(spark, str(tmp_path), str(tmp_path / "saved"))
    kept.create(config(tmp_path, "kept"))
    later = Manager(spark, str(tmp_path), str(tmp_path / "saved"))
    assert later.restore() == ["kept"] and later.delete("kept") and Manager(spark, "", str(tmp_path / "saved")).restore() == []
    assert m.statuses() == {"copy": "INIT"} and m.delete("copy") and not m.delete("copy")
    assert "LdesClient" in catalog()["inputs"] and "RmlAdapter" in catalog()["adapters"]
    assert "HttpEnricher" in catalog()["transformers"] and "AmqpOut" in catalog()["outputs"]
    with pytest.raises(ValueError, match="unknown component"):
        find(OUTPUTS, "XNoopOut")


def test_frame(spark):
    rows = [("m", None, "http://e/a", "iri", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T", "iri", None, None), ("m", None, "http://e/a", "iri", "http://e/k", "b", "bnode", None, None), ("m", None, "b", "bnode", "http://e/n", "x", "literal", None, None)]
    frame = {"@context": {"n": "http://e/n", "k": "http://e/k", "T": "http://e/T"}, "@type": "T"}
    out = text.serialise(spark.createDataFrame(rows, SCHEMA), "application/ld+json", frame=frame).first().content
    assert '"n": "x"' in out and '"@type": "T"' in out
