"""Models held as rows: the same results as quads, without exchanges of statements."""

import json

from pyspark.sql import functions as F

from tessera import queries as core
from tessera.operators import quads as Q
from tessera.operators import versions
from tessera.plans import sparql
from tessera.sinks import text
from tessera.sources import rdf_text
from tessera.vocabulary import LANG_STRING, RDF_TYPE, XSD_DATETIME, XSD_STRING


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, Q.statements(df).select(*Q.COLUMNS).collect()), key=repr)


def gathered(quads):
    return quads.groupBy("model_id").agg(F.collect_set(F.struct(*Q.COLUMNS[1:])).alias("statements"))


def quad(m, s, p, o, kind="iri", dt=None, g=None, s_kind="iri"):
    return (m, g, s, s_kind, p, o, kind, dt, None)


def test_a_lift_unites_rows_of_a_model_and_joins_tables_once(spark, sf):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (2, "c")], "k long, v string")
    models = Q.lift_models(t, F.col("k"), lambda c: [(F.concat(F.lit("http://e/"), c("k").cast("string")), {"http://e/v": Q.literal(c("v"))}, "http://e/T")], 3)
    assert {(r.model_id, len(r.statements)) for r in models.collect()} == {("1", 2), ("2", 3)}
    orders = core.order_quads(spark, sf)
    assert plan(orders).count("Join") <= 1
    assert "Exchange" not in plan(orders.groupBy("model_id").count()).split("Generate")[0]


def test_route_looks_up_hits_only_and_loses_no_model(spark, sf):
    q = spark.createDataFrame([quad("1", "http://e/a", "http://e/p", "http://e/b", g="http://e/g"), quad("2", "http://e/a", "http://e/q", "http://e/b")], Q.SCHEMA)
    ask = "ASK FROM <http://e/g> { ?s <http://e/p> ?o }"
    for form in (q, gathered(q)):
        yes, no = sparql.route(form, ask)
        assert [r.model_id for r in yes.collect()] == ["1"]
        assert [r.model_id for r in no.collect()] == ["2"]  # nothing of it is in the graph
    assert plan(core.route_ask(spark, sf)).count("Join") <= 6


def test_materialised_rows_equal_materialised_quads(spark, sf):
    of = versions.VERSION_OF
    data = [quad("1", "http://e/a#1", of, "http://e/a"), quad("1", "http://e/a#2", of, "http://e/a"), quad("1", "http://e/a#2", of, "http://e/A"), quad("1", "http://e/a#1", of, "text", "literal")]
    data += [quad("1", f"http://e/a#{n}", "http://e/p", "http://e/a#1") for n in (1, 2, 3)] + [quad("1", "http://e/a", "http://e/p", "http://e/a"), quad("1", "http://e/a", "http://e/p", "http://e/a#1", "literal")]
    data += [quad("2", "http://e/b", "http://e/p", "http://e/a#1"), quad("4", "http://e/b#1", of, "b", "bnode"), quad("4", "http://e/b#1", "http://e/p", "1", "literal", g="http://e/g")]
    many = [quad("3", f"http://e/{n}#{v}", p, o, k) for n in range(40) for v in (1, 2) for p, o, k in ((of, f"http://e/{n}", "iri"), ("http://e/p", f"http://e/{n}#1", "iri"), ("http://e/q", f"http://e/{n}#1", "literal"))]
    q = spark.createDataFrame(data + many, Q.SCHEMA)
    wanted = rows(versions.materialise_versions(q))
    assert len([r for r in wanted if r[0] == "3"]) == 80 and ("2", None, "http://e/b", "iri", "http://e/p", "http://e/a#1", "iri", None, None) in wanted
    assert rows(versions.materialise_versions(gathered(q))) == wanted
    assert plan(core.version_materialise(spark, sf)).count("Exchange hashpartitioning") <= 2 * 4  # two ways; before, statements were written and travelled three times
    assert "tessera-versions" not in plan(core.version_materialise(spark, sf))


def test_version_rows_equal_version_quads(spark, sf):
    kind, at, stamp = RDF_TYPE, "http://e/at", XSD_DATETIME
    data = [quad("1", "http://e/b", kind, "http://e/T"), quad("1", "http://e/a", kind, "http://e/T"), quad("1", "http://e/a", at, "2024", "literal", stamp), quad("1", "http://e/b", at, "2023", "literal", stamp), quad("1", "http://e/a", "http://e/p", "http://e/a")]
    data += [quad("1", "http://e/a/2023", "http://e/p", "http://e/a"), quad("1", "http://e/a/2023", versions.VERSION_OF, "http://e/a")]  # met by what is renamed and stated
    data += [quad("2", "http://e/c", at, "2024", "literal", stamp), quad("3", "http://e/d", kind, "http://e/T", g="http://e/g"), quad("3", "http://e/d", "http://e/n", "x", "bnode"), quad("3", "x", at, "2022", "literal", stamp, s_kind="bnode")]
    q = spark.createDataFrame(data, Q.SCHEMA)
    for path in ((), (at,), ("http://e/n", at)):
        for of in (versions.VERSION_OF, None):
            wanted = rows(versions.create_version_objects(q, ["http://e/T"], path, now=F.lit("now"), version_of=of))
            assert rows(versions.create_version_objects(gathered(q), ["http://e/T"], path, now=F.lit("now"), version_of=of)) == wanted
    assert "Window" not in plan(core.version_object(spark, sf))
    assert "HashAggregate(keys=[model_id#" not in plan(core.version_object(spark, sf)).replace("ObjectHashAggregate", "")


def test_json_ld_of_rows_and_flat_documents():
    data = [("http://e/a", "iri", RDF_TYPE, "http://e/T", "iri", None, None), ("b", "bnode", "http://e/p", "x", "bnode", None, None), ("http://e/a", "iri", "http://e/p", 'é"\n\\', "literal", XSD_STRING, None)]
    data += [("http://e/a", "iri", "http://e/p", "v", "literal", LANG_STRING, "en"), ("http://e/a", "iri", "http://e/p", "v", "literal", XSD_DATETIME, None), ("http://e/a", "iri", "http://e/p", "v", "literal", None, None)]
    written = text.json_ld(data)
    assert written == json.dumps(json.loads(written), indent=2, ensure_ascii=False) and text.json_ld([]) == "[]"
    documents = [written, '{"@id": "http://e/a", "http://e/p": [{"@value": "v", "@language": "EN"}], "http://e/q": []}']
    odd = ['[{"@id": "a", "http://e/p": [1]}]', '{"@id": "http://e/a", "http://e/p": [{"@value": "v", "@language": null}]}', '{"@id": "http://e/a", "@type": ["T"]}', '{"http://e/p": [{"@value": "v"}]}', '{"@id": "http://e/a", "http://e/p": [{"@value": "v", "@type": "@json"}]}']
    for d in documents + odd:
        parser = rdf_text.JsonLd()
        for item in json.loads(d) if d.startswith("[") else [json.loads(d)]:
            parser.node(None, item, {})
        assert rdf_text.parse_json_ld(d) == list(dict.fromkeys(parser.rows))
        assert (rdf_text._flat_nodes(json.loads(d)) is not None) == (d in documents)


def test_lines_of_whole_models_are_a_set(spark, sf):
    lines = ['<http://e/a> <http://e/p> "v" .', '<http://e/a>  <http://e/p>\t"v"^^<http://www.w3.org/2001/XMLSchema#string> . # again', '<http://e/a> <http://e/p> "\\u0076" .', "", "# none", '<http://e/a> <http://e/p> "v"@EN .', '<http://e/a> <http://e/p> "v"@en .', '_:b <http://e/p> "a\\"b" <http://e/g> .']
    docs = [("1", "\n".join(lines)), ("2", "\r\n".join(lines[:2])), ("3", lines[0] + "\n" + lines[0].replace(" ", "")), ("4", lines[5] + "\n" + lines[6]), ("5", lines[7] + "\n"), ("6", "")]
    contents = spark.createDataFrame(docs, "model_id string, content string").withColumn("mime_type", F.lit("application/n-quads"))
    wanted = rows(rdf_text.adapt(contents))
    assert rows(rdf_text.adapt(contents, whole_models=True)) == wanted and len(wanted) == 7
    assert "keys=[model_id" not in plan(core.nquads_round_trip(spark, sf)).replace("ObjectHashAggregate(keys=[model_id", "").replace("SortAggregate(keys=[model_id", "")


def test_simple_turtle_equals_the_parser():
    simple = ['<http://e/a> a <http://e/T> ;\n    <http://e/p> "v", "w"^^<http://e/d>, "x"@En-us, _:b.c .\n_:b.c <http://e/p> "" .', ""]
    other = ["@prefix e: <http://e/> . e:a e:p 1 .", '<http://e/a> <http://e/p> """x""" .', '<http://e/a> <http://e/p> "\\n" .', "<http://e/a> <http://e/p> <b> .", "<http://e/a> <http://e/p> [ a <http://e/T> ] ; ."]
    for d in simple + other:
        parsed = [rdf_text._row(s, p[1], o, g) for g, s, p, o in rdf_text.TurtleParser(d).statements()]
        assert rdf_text.parse_turtle(d) == list(dict.fromkeys(parsed))
        assert (rdf_text._simple_turtle(d) is not None) == (d in simple)
    for broken in ("<http://e/a> <http://e/p> .", '"v" <http://e/p> <http://e/a> .', "<http://e/a> <http://e/p> <http://e/b>"):
        assert rdf_text._simple_turtle(broken) is None
