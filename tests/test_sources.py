import http.server
import threading
from datetime import datetime

import pytest

from tessera.functions import geo
from tessera.operators import canonical, enrich, geojson, versions
from tessera.operators.quads import SCHEMA
from tessera.plans import rml
from tessera.sinks import stores, text
from tessera.sources import http as client
from tessera.sources import contexts, json_adapters, ldes, messages, rdf_text, schedule
from tessera.vocabulary import GEOJSON, TREE


def page(n, last):
    relation = "" if n == last else f"<http://e/p{n}> <{TREE}relation> _:r .\n_:r <{TREE}node> <{{base}}/page/{n + 1}> .\n_:r <{TREE}path> <http://e/t> .\n"
    members = "".join(f"<http://e/s> <{TREE}member> <http://e/m{n}{i}> .\n<http://e/m{n}{i}> <http://e/t> \"2024-01-0{n}T0{i}:00:00Z\"^^<http://www.w3.org/2001/XMLSchema#dateTime> .\n" for i in range(2))
    return relation + members


@pytest.fixture(scope="module")
def server():
    state = {"hits": {}, "failures": 1}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            base = f"http://127.0.0.1:{self.server.server_port}"
            state["hits"][self.path] = state["hits"].get(self.path, 0) + 1
            status, headers, body = 200, {"Content-Type": "application/n-quads"}, ""
            if self.path == "/view":
                status, headers = 302, {"Location": "/start"}
            elif self.path == "/start":
                body = f"<{base}/start> <{TREE}view> <{base}/page/1> .\n"
            elif self.path.startswith("/page/"):
                n = int(self.path[6:])
                headers["Cache-Control"] = "public, immutable" if n < 3 else "max-age=30"
                body = page(n, 3).replace("{base}", base)
            elif self.path == "/flaky" and state["hits"][self.path] <= state["failures"]:
                status, headers = 503, {"Retry-After": "0"}
            elif self.path == "/missing":
                status = 404
            data = body.encode()
            self.send_response(status)
            for k, v in {**headers, "Content-Length": str(len(data))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):
            state["posted"] = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *_):
            pass

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", state
    httpd.shutdown()


def test_http_layer(server):
    base, state = server
    run = client.with_retries(client.urllib_executor(), sleep=lambda _: None)
    assert run(client.Request(base + "/flaky")).status == 200
    assert run(client.Request(base + "/missing")).status == 404
    assert client.follow_redirects(run, client.Request(base + "/view")).status == 200
    assert client.retry_after("7", 0) == 7 and client.retry_after("nonsense", 0) is None
    slept = []
    limited = client.with_rate_limit(lambda r: client.Response(200, {}, b""), 2, 10, slept.append, lambda: 0.0)
    for _ in range(3):
        limited(client.Request("http://x"))
    assert slept == [10]
    keyed = client.with_api_key(lambda r: client.Response(200, r.headers, b""), "k")
    assert keyed(client.Request("http://x")).header("x-api-key") == "k"


def test_token_is_kept_until_it_expires():
    now, asked = [0.0], []

    def fake(r):
        if r.url == "http://token":
            asked.append(1)
            return client.Response(200, {}, b'{"access_token": "t", "expires_in": 100}')
        return client.Response(200, r.headers, b"")

    run = client.with_client_credentials(fake, "http://token", "id", "secret", clock=lambda: now[0])
    run(client.Request("http://x"))
    now[0] = 69
    assert run(client.Request("http://x")).header("Authorization") == "Bearer t" and len(asked) == 1
    now[0] = 71
    run(client.Request("http://x"))
    assert len(asked) == 2


def test_ldes_batch_and_stream(spark, server, tmp_path):
    base, _ = server
    spark.dataSource.register(ldes.LdesDataSource)
    got = spark.read.format("ldes").option("urls", base + "/view").option("timestamp-path", "http://e/t").load()
    assert {r.member_id for r in got.collect()} == {f"http://e/m{n}{i}" for n in (1, 2, 3) for i in (0, 1)}
    stream = spark.readStream.format("ldes").option("urls", base + "/view").load()
    for _ in range(2):  # a restart resumes and gives nothing twice
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            for _ in range(60):
                if q.lastProgress and q.lastProgress["numInputRows"] >= 0 and (tmp_path / "out").exists():
                    break
                q.awaitTermination(0.5)
            q.awaitTermination(2)
        finally:
            q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_frontier_forgets_immutable_pages():
    f = ldes.Frontier()
    f.add("u")
    rows = [(None, "s", "iri", TREE + "member", "m", "iri", None, None)]
    assert [m[0] for m in f.visited(ldes.Page("u", 200, rows, [], True, 60), 0.0)] == ["m"]
    assert f.due(30.0) is None and f.due(61.0) == "u"
    assert f.visited(ldes.Page("u", 200, rows, ["v"], False), 61.0) == []
    assert f.nodes["u"] == {"status": "IMMUTABLE", "next": 60.0, "received": [], "etag": None} and f.due(61.0) == "v" and not f.ended()


def test_discoverer(server):
    base, _ = server
    root, edges = ldes.discover(client.urllib_executor(), base + "/start")
    assert root == base + "/page/1" and [e[2] for e in edges] == [True, True]
    assert ldes.structure_text("a", [("a", "b", True), ("a", "c", True), ("b", "d", True)]) == "a\n+- b\n|  +- d\n+- c\n"


def test_turtle_json_ld_and_canonical_forms():
    turtle = '@prefix ex: <http://e/> . ex:a ex:l ( 1 "b"@nl ) ; ex:n [ ex:x true ] .'
    rows = rdf_text.parse_turtle(turtle)
    assert len(rows) == 7
    again = rdf_text.parse_turtle(text.turtle([r[1:] for r in rows], {"ex": "http://e/"}))
    linked = rdf_text.parse_json_ld(text.json_ld([r[1:] for r in rows]))
    assert canonical.canonical(rows) == canonical.canonical(again) == canonical.canonical(linked)
    ring = [(None, x, "bnode", "p", y, "bnode", None, None) for x, y in ("ab", "bc", "ca")]
    pair = [(None, x, "bnode", "p", y, "bnode", None, None) for x, y in ("zx", "xy", "yz")]
    two = [(None, x, "bnode", "p", y, "bnode", None, None) for x, y in ("ab", "ba", "cc")]
    assert canonical.canonical(ring) == canonical.canonical(pair) != canonical.canonical(two)


def test_lines_and_their_errors(spark):
    good = spark.createDataFrame([("m", '_:b <p:q> "a\\"b\\n\\u00e9"@EN-us .'), ("m", "# note"), ("m", ""), ("m", "<s:s> <p:p> <o:o> <g:g> .")], "model_id string, value string")
    rows = {tuple(r) for r in rdf_text.parse_lines(good).collect()}
    lang = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
    assert rows == {("m", None, "b", "bnode", "p:q", 'a"b\né', "literal", lang, "en-us"), ("m", "g:g", "s:s", "iri", "p:p", "o:o", "iri", None, None)}
    with pytest.raises(Exception, match="not a statement"):
        rdf_text.parse_lines(spark.createDataFrame([("m", "<s> oops")], "model_id string, value string")).collect()


def test_long_and_odd_literals(spark):
    values = ["x" * 2000, "y" * 1_000_000, "\\" * 5000, '"' * 5000 + "\\", "a\x01b", "tab\there", "new\nline\r", "# not a comment . ", "smile \U0001f600 \u2028 é", "", "'", 'end\\"', "\\u0041"]
    rows = [(str(i), None, "http://e/s", "iri", "http://e/p", v, "literal", "http://www.w3.org/2001/XMLSchema#string", None) for i, v in enumerate(values)]
    lines = text.nquads(spark.createDataFrame(rows, SCHEMA)).withColumn("mime_type", canonical.F.lit("application/n-quads"))
    assert {(r.model_id, r.o) for r in rdf_text.adapt(lines).collect()} == {(str(i), v) for i, v in enumerate(values)}
    escaped = spark.createDataFrame([("m", r'<s:s> <p:p> "\U0001F600\u00e9\U00000022\'\t" . # "more"'), ("m", "_:a <p:p> _:b.c.")], "model_id string, value string")
    assert {(r.s, r.o) for r in rdf_text.parse_lines(escaped).collect()} == {("s:s", "\U0001f600é\"'\t"), ("a", "b.c")}


def test_polling_times():
    at = datetime(2024, 2, 28, 23, 59, 30)
    assert schedule.Cron("0 */15 * * * *").after(at) == datetime(2024, 2, 29)
    assert schedule.Cron("0 30 8 ? MAR MON-FRI").after(at) == datetime(2024, 3, 1, 8, 30)
    assert schedule.Cron("*/10 * * * * *").after(at) == datetime(2024, 2, 28, 23, 59, 40)
    assert schedule.seconds_of("PT1M30S") == 90 and schedule.trigger_interval("PT0.5S") == "500 milliseconds" and schedule.trigger_interval("5 seconds") == "5 seconds"
    for wrong in ("* * * * *", "61 * * * * *", "0 0 0 31 2 ?"):
        with pytest.raises(ValueError):
            schedule.Cron(wrong).after(at)
    with pytest.raises(ValueError):
        schedule.seconds_of("P")


def test_queues_and_polls_give_a_restart_what_they_took(tmp_path, server):
    queue = [("<a:a> <b:b> <c:c> .", None), ("x", "text/turtle")]
    messages.QUEUE_CLIENTS["test"] = lambda _: [queue.pop(0)] if queue else []
    reader = messages.QueueReader({"client": "test", "spool": str(tmp_path / "q")})
    start = reader.initialOffset()
    first, middle = reader.read(start)
    second, end = reader.read(middle)
    assert [*first, *second] == [("queue-0", "<a:a> <b:b> <c:c> .", "application/n-quads"), ("queue-1", "x", "text/turtle")]
    later = messages.QueueReader({"client": "test", "spool": str(tmp_path / "q")})
    assert [r[0] for r in later.readBetweenOffsets(start, end)] == ["queue-0", "queue-1"] and list(later.read(middle)[0])[0][1] == "x"
    later.commit(end)
    with pytest.raises(OSError, match="spool"):
        later.readBetweenOffsets(start, end)
    base, state = server
    poll = messages.HttpPoll({"urls": base + "/start", "spool": str(tmp_path / "p")})
    rows, after = poll.read(poll.initialOffset())
    asked = state["hits"]["/start"]
    assert list(poll.readBetweenOffsets({"n": 0}, after)) == list(rows) and state["hits"]["/start"] == asked
    clock = [datetime(2024, 1, 1, 0, 0, 1)]
    timed = messages.HttpPoll({"urls": base + "/start", "cron": "0 * * * * *"}, lambda: clock[0])
    assert timed.read({"n": 0})[1] == {"n": 0}
    clock[0] = datetime(2024, 1, 1, 0, 1)
    assert timed.read({"n": 0})[1] == {"n": 1}


def test_contexts_are_fetched_once_and_the_oldest_forgotten():
    asked = []

    def fake(r):
        asked.append(r.url)
        return client.Response(404 if r.url.endswith("none") else 200, {}, b'{"@context": {"n": "http://e/n"}}', r.url)

    contexts.clear()
    remote = contexts.RemoteContexts(capacity=2, given={"urn:own": '{"@context": {"n": "http://own/n"}}'}, execute=fake)
    rows = [rdf_text.parse_json_ld('{"@context": "%s", "n": 1}' % c, remote) for c in ("http://a", "http://a", "urn:own")]
    assert [r[0][3] for r in rows] == ["http://e/n", "http://e/n", "http://own/n"] and asked == ["http://a"]
    for name in ("http://b", "http://c", "http://a"):
        assert remote[name]
    assert asked == ["http://a", "http://b", "http://c", "http://a"]
    with pytest.raises(ValueError, match="answered 404"):
        remote["http://none"]
    with pytest.raises(ValueError, match="not registered"):
        rdf_text.parse_json_ld('{"@context": "urn:other", "n": 1}', remote)


def test_rate_limits_hold_for_all_requests(spark, server):
    base, _ = server
    rows = spark.range(8).selectExpr("cast(id AS string) AS model_id", "'x' AS content").repartition(4)
    assert stores.http_out(rows, base + "/in", "text/plain", {"rate-limit.enabled": "true"}).rdd.getNumPartitions() == 1


def test_timestamp_path_from_the_stream():
    text_ = f"<http://s> a <{ldes.LDES}EventStream> ; <{ldes.LDES}timestampPath> <http://e/t> ."
    run = lambda r: client.Response(200, {"Content-Type": "text/turtle"}, text_.encode(), r.url)
    assert ldes.timestamp_path(run, {"timestamp-path": "auto", "urls": "http://s"}) == "http://e/t"
    assert ldes.timestamp_path(run, {"timestamp-path": "http://own"}) == "http://own" and ldes.timestamp_path(run, {}) is None


def test_client_status():
    f = ldes.Frontier()
    f.add("u")
    status = lambda: ldes.client_status({"frontier": ldes.json.dumps(f.nodes)})
    assert status() == "REPLICATING"
    f.visited(ldes.Page("u", 200, [], [], True, 60), 0.0)
    assert status() == "SYNCHRONISING"
    f.visited(ldes.Page("u", 200, [], [], False), 0.0)
    assert status() == "COMPLETED"


def test_ngsi():
    entity = {"id": "1", "type": "T", "dateObserved": "2020-01-01T00:00:00", "a": {"type": "Number", "value": 5, "metadata": {"unitCode": {"value": "C"}}}, "r": {"type": "Reference", "value": "urn:x"}}
    made = json_adapters.ngsi_to_ld(entity, ["c"])
    assert made["id"] == "urn:ngsi-ld:T:1" and made["a"] == {"type": "Property", "value": 5, "unitCode": "C", "observedAt": "2020-01-01T00:00:00Z"}
    assert made["r"] == {"type": "Relationship", "object": "urn:x"}
    with pytest.raises(ValueError, match="reference"):
        json_adapters.ngsi_to_ld({"id": "1", "type": "T", "r": {"type": "Reference", "value": 5}}, [])


def test_json_adapter_rules(spark):
    rows = spark.createDataFrame([("m", '[{"@id":"http://e/1","v":1,"@context":{"v":"http://old/v"}},{"@id":"http://e/2","v":2}]', "application/json")], "model_id string, content string, mime_type string")
    got = json_adapters.json_to_ld(rows, {"@vocab": "http://new/"}).orderBy("model_id").collect()
    assert [(r.model_id, r.p) for r in got] == [("m#0", "http://new/v"), ("m#1", "http://new/v")]
    with pytest.raises(Exception, match="unsupported mime type"):
        json_adapters.json_to_ld(rows.replace("application/json", "text/plain"), {}).collect()


MAPPING = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix ex: <http://e/> .
ex:M rml:logicalSource [ rml:referenceFormulation ql:%s %s ] ; rr:subjectMap [ rr:template "http://e/{id}" %s ] ; rr:predicateObjectMap [ rr:predicate ex:v ; rr:objectMap [ rml:reference "v" ] ] ."""


@pytest.mark.parametrize(("kind", "iterator", "content"), [("CSV", "", "id,v\n1,a\n2,b\n"), ("XPath", '; rml:iterator "/r/i"', "<r><i><id>1</id><v>a</v></i><i><id>2</id><v>b</v></i></r>"), ("JSONPath", '; rml:iterator "$[*]"', '[{"id":1,"v":"a"},{"id":2,"v":"b"}]')])
def test_rml_formats(spark, kind, iterator, content):
    rows = spark.createDataFrame([("m", content)], "model_id string, content string")
    got = rml.apply_mapping(rows, MAPPING % (kind, iterator, "")).collect()
    assert {(r.s, r.o) for r in got} == {("http://e/1", "a"), ("http://e/2", "b")}


def test_rml_graphs_become_models(spark):
    rows = spark.createDataFrame([("m", "id,v\n1,a\n2,b\n")], "model_id string, content string")
    got = rml.apply_mapping(rows, MAPPING % ("CSV", "", '; rr:graphMap [ rr:template "http://g/{id}" ]')).collect()
    assert {(r.model_id, r.s) for r in got} == {("m#graph=http://g/1", "http://e/1"), ("m#graph=http://g/2", "http://e/2")}


def nested(value, rows, label):
    if not isinstance(value, list):
        return str(value), "literal"
    head = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", "iri")
    for i, item in reversed(list(enumerate(value))):
        b = f"{label}_{i}"
        rows.append((b, rdf_text.RDF + "first", *nested(item, rows, b)))
        rows.append((b, rdf_text.RDF + "rest", *head))
        head = (b, "bnode")
    return head


@pytest.mark.parametrize(
    ("kind", "coordinates", "wkt"),
    [
        ("Point", [100, 0.5, 7], "POINT (100 0.5)"),
        ("LineString", [[100, 0], [101, 1]], "LINESTRING (100 0, 101 1)"),
        ("MultiPoint", [[1, 2], [3, 4]], "MULTIPOINT ((1 2), (3 4))"),
        ("Polygon", [[[0, 0], [1, 0], [0, 0]], [[2, 2], [3, 3], [2, 2]]], "POLYGON ((0 0, 1 0, 0 0), (2 2, 3 3, 2 2))"),
        ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]], "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"),
        ("MultiPolygon", [[[[0, 0], [1, 0], [0, 0]]]], "MULTIPOLYGON (((0 0, 1 0, 0 0)))"),
    ],
)
def test_geometries(kind, coordinates, wkt):
    rows = [("g", rdf_text.RDF_TYPE, GEOJSON + kind, "iri")]
    rows.append(("g", geojson.COORDINATES, *nested(coordinates, rows, "c")))
    assert geojson.geometry_wkt(rows, "g") == (kind, wkt)
    with pytest.raises(ValueError, match="not supported"):
        geojson.geometry_wkt([("g", rdf_text.RDF_TYPE, GEOJSON + "Square", "iri")], "g")


def test_geo():
    line = "<http://crs> LINESTRING(4 51, 5 51, 5 52)"
    total = geo.line_length(line)
    assert abs(geo.geodesic(0, 0, 1, 0) - 111319.4908) < 1e-3 and geo.geodesic(1, 1, 1, 1) == 0
    assert abs(geo.distance_from_start(line, geo.point_at(line, 100000.0)) - 100000) < 50
    assert geo.point_at(line, total + 1) is None and geo.mid_point(line).startswith("<http://crs> POINT(")
    assert geo.line_length(None) is None


def test_versions(spark):
    assert versions.member_filters(None, False) == ["exactly_once"]
    assert versions.member_filters(None, True) == ["latest_state", "materialise"]
    assert versions.member_filters(None, True, False) == ["materialise"]
    with pytest.raises(ValueError):
        versions.member_filters(True, True)
    rows = [("m", None, "a", "iri", "http://e/x", "1", "literal", None, None), ("m", None, "b", "iri", "http://e/x", "1", "literal", None, None)]
    with pytest.raises(Exception, match="one named subject"):
        canonical.member_hashes(spark.createDataFrame(rows, SCHEMA)).collect()
    plain = spark.createDataFrame(rows, SCHEMA)
    assert versions.create_version_objects(plain, ["http://e/T"]).count() == 2  # no member: as it was


def test_files_and_updates(spark, tmp_path):
    t = "http://e/t"
    rows = [(m, None, f"http://e/{m}", "iri", t, "2024-02-03T04:05:06.5Z", "literal", None, None) for m in ("a", "b")]
    q = spark.createDataFrame(rows, SCHEMA)
    assert stores.archive_out(q, str(tmp_path / "out"), t) == 2
    names = sorted(p.name for p in (tmp_path / "out/2024/02/03").iterdir())
    assert names == ["2024-02-03-04-05-06-500000000-1.ttl", "2024-02-03-04-05-06-500000000.ttl"]
    back = messages.archive(spark, str(tmp_path / "out")).orderBy("position")
    assert rdf_text.adapt(back).count() == 2
    assert stores.blob_out(q, str(tmp_path / "blobs")) == 2
    assert stores.delete_where(None) is None and "?root (a|!a)?/(a|!a)? ?node" in stores.delete_where(2) and stores.delete_where(0, "http://g").startswith("WITH <http://g> DELETE")
    with pytest.raises(ValueError):
        stores.delete_where(-1)
    assert stores.insert_sql("t", ["a", "b"], "n") == 'INSERT INTO t ("a", "b") SELECT "a", "b" FROM n fresh ON CONFLICT DO NOTHING'


def test_http_out(spark, server):
    base, state = server
    rows = spark.createDataFrame([("a", "hello"), ("b", "")], "model_id string, content string")
    assert [tuple(r) for r in stores.http_out(rows, base + "/in", "text/plain").collect()] == [("a", 200)]
    assert state["posted"] == b"hello"
    with pytest.raises(Exception, match="answered 405|answered 501|answered 404|answered"):
        stores.http_out(rows, "http://127.0.0.1:9/none", "text/plain", {"retries.enabled": "false"}, continue_on_fail=False).collect()


def test_connector_fetches_tokens_again():
    tokens, seen = iter(["old", "new"]), []

    def fake(r):
        if r.url == "http://token":
            return client.Response(200, {}, b'{"authCode": "%s"}' % next(tokens).encode())
        if r.url == "http://transfer":
            return client.Response(200, {}, b"{}")
        seen.append((r.url, r.headers["Authorization"]))
        return client.Response(403 if r.headers["Authorization"] == "old" else 200, {}, b"")

    options = {"connector.transfer-url": "http://transfer", "connector.token-url": "http://token"}
    run = client.connector_executor(fake, "http://public", "http://connector", lambda: client.connector_token(fake, options))
    got = run(client.Request("http://public/page"))
    assert got.status == 200 and got.url == "http://public/page" and seen == [("http://connector/page", "old"), ("http://connector/page", "new")]


def test_enrichment_by_http(spark):
    rows = [("m1", None, "http://e/a", "iri", "http://e/url", "http://x/1", "literal", None, None), ("m2", None, "http://e/a", "iri", "http://e/url", "http://x/bad", "literal", None, None)]

    def fetch(method, url, body, headers):
        return (200, "text/turtle", "<http://e/a> <http://e/new> 1 .") if url.endswith("1") and method == "GET" else (500, "", "")

    got = enrich.http_enrich(spark.createDataFrame(rows, SCHEMA), fetch, "http://e/url").collect()
    assert sorted((r.model_id, r.p) for r in got) == [("m1", "http://e/new"), ("m1", "http://e/url"), ("m2", "http://e/url")]


def test_routes(spark):
    rows = [(m, None, "http://e/a", "iri", "http://e/p", "1", "literal", None, None) for m in ("m1", "m2")]
    q = spark.createDataFrame(rows, SCHEMA)
    changed, same = canonical.route_changed(q, q.replace("m1", "m1").withColumn("o", canonical.F.when(canonical.F.col("model_id") == "m1", "2").otherwise(canonical.F.col("o"))))
    assert [r.model_id for r in changed.collect()] == ["m1"] and [r.model_id for r in same.collect()] == ["m2"]


def test_times_keep_the_wall_clock(spark):
    rows = [("m", None, "http://e/a", "iri", "http://e/t", "2024-01-01T10:00:00+05:00", "literal", None, None)]
    assert str(versions.timestamps(spark.createDataFrame(rows, SCHEMA), "http://e/t").first().ts) == "2024-01-01 10:00:00"


def test_tables_by_jdbc(spark):
    url, driver = "jdbc:derby:memory:out;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, n int")
    stores._execute(spark, url, driver, 'CREATE TABLE t ("k" VARCHAR(100), "n" INT)')
    stores.rdb_out(rows.limit(1), url, "t", driver)
    stores.rdb_out(rows, url, "t", driver, ignore_duplicates=True, keys=["k"])
    assert sorted((r.k or r.K, r.n) for r in spark.read.jdbc(url, "t", properties=driver).toDF("k", "n").collect()) == [("a", 1), ("b", 2)]


def test_mapping_functions_go_by_local_name(spark):
    f = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix ex: <http://e/> .
    @prefix fnml: <http://semweb.mmlab.be/ns/fnml#> . @prefix fno: <https://w3id.org/function/ontology#> . @prefix f: <http://any/ns#> .
    ex:M rml:logicalSource [ rml:referenceFormulation ql:CSV ] ; rr:subjectMap [ rr:template "http://e/{id}" ] ; rr:predicateObjectMap [ rr:predicate ex:w ; rr:objectMap [ fnml:functionValue [
      rr:predicateObjectMap [ rr:predicate fno:executes ; rr:objectMap [ rr:constant f:toWkt ] ] , [ rr:predicate f:coordinates ; rr:objectMap [ rml:reference "c" ] ] , [ rr:predicate f:wktType ; rr:objectMap [ rr:constant "POINT" ] ] ] ] ] ."""
    rows = spark.createDataFrame([("m", "id,c\n1,4.5 51\n2,\n")], "model_id string, content string")
    assert [r.o for r in rml.apply_mapping(rows, f).collect()] == ["<http://www.opengis.net/def/crs/OGC/1.3/CRS84>POINT(4.5 51)"]
