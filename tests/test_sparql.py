import pytest

from tessera.operators.quads import SCHEMA
from tessera.plans import sparql
from tessera.plans.sparql_parser import SparqlError, parse, parse_path
from tessera.sources.rdf_text import parse_turtle

P = "PREFIX ex: <http://e/> "
DATA = """@prefix ex: <http://e/> .
ex:a ex:p 1, 2 ; ex:q "x"@en ; ex:next ex:b . ex:b ex:p 3 ; ex:next ex:c . ex:c ex:p 10 ; ex:next ex:a .
ex:g1 { ex:a ex:in ex:g1 } ex:g2 { ex:b ex:in ex:g2 }"""


@pytest.fixture(scope="module")
def quads(spark):
    rows = [(m, *r) for m in ("m1", "m2") for r in parse_turtle(DATA) if m == "m1" or r[4] != "10"]
    return spark.createDataFrame(rows, SCHEMA).cache()


def run(quads, text, model="m1"):
    found = sparql.values(sparql.select(quads, P + text)).where(f"model_id = '{model}'").drop("model_id")
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT ?o { ex:a ex:p ?o }", [("1",), ("2",)]),
        ("SELECT ?s { ?s ex:p ?o FILTER(?o > 2.5) }", [("http://e/b",), ("http://e/c",)]),
        ("SELECT ?s ?l { ?s ex:p ?o OPTIONAL { ?s ex:q ?l FILTER(?o = 2) } FILTER(?o < 3) }", [("http://e/a", "x"), ("http://e/a", None)]),
        ("SELECT (SUM(?o) AS ?t) { ?s ex:p ?o }", [("16",)]),
        ("SELECT (COUNT(DISTINCT ?s) AS ?n) { ?s ex:p ?o }", [("3",)]),
        ("SELECT (COUNT(*) AS ?n) { ?s ex:absent ?o }", [("0",)]),
        ("SELECT ?e { ex:a ex:next* ?e }", [("http://e/a",), ("http://e/b",), ("http://e/c",)]),
        ("SELECT ?e { ex:a ex:next+ ?e }", [("http://e/a",), ("http://e/b",), ("http://e/c",)]),
        ("SELECT ?s { ?s ex:next+ ex:b }", [("http://e/a",), ("http://e/b",), ("http://e/c",)]),
        ("SELECT ?s { ?s ex:in* ex:g1 }", [("http://e/g1",)]),
        ("SELECT ?e { ex:a ex:next? ?e }", [("http://e/a",), ("http://e/b",)]),
        ("SELECT ?e { ex:a ^ex:next/ex:p ?e }", [("10",)]),
        ("SELECT ?p { ex:a !(ex:p|ex:next) ?p }", [("x",)]),
        ("SELECT ?g ?s { GRAPH ?g { ?s ex:in ?g } }", [("http://e/g1", "http://e/a"), ("http://e/g2", "http://e/b")]),
        ("SELECT ?s { ?s ex:p ?o MINUS { ?s ex:q ?l } }", [("http://e/b",), ("http://e/c",)]),
        ("SELECT ?x { VALUES (?s ?x) { (ex:a UNDEF) (ex:b 3) } ?s ex:p ?x }", [("1",), ("2",), ("3",)]),
        ('SELECT ?l { ?s ex:q ?l FILTER(LANG(?l) = "en" && LANGMATCHES(LANG(?l), "*")) }', [("x",)]),
        ('SELECT ?v { ex:a ex:q ?l BIND(UCASE(SUBSTR(CONCAT(?l, "yz"), 2)) AS ?v) }', [("YZ",)]),
        ("SELECT ?s (MAX(?o) AS ?m) { ?s ex:p ?o } GROUP BY ?s HAVING(MAX(?o) >= 3)", [("http://e/b", "3"), ("http://e/c", "10")]),
        ("SELECT ?o { ?s ex:p ?o } ORDER BY DESC(?o) LIMIT 2", [("10",), ("3",)]),
        ('SELECT ?v { ex:a ex:q ?l BIND(IF(BOUND(?z), "bound", COALESCE(?z, "free")) AS ?v) }', [("free",)]),
        ("SELECT ?s { ?s ex:p ?o FILTER EXISTS { ?s ex:q ?l } }", [("http://e/a",), ("http://e/a",)]),
    ],
)
def test_select(quads, text, expected):
    assert run(quads, text) == sorted(expected, key=repr)


def test_models_are_apart(quads):
    assert run(quads, "SELECT (SUM(?o) AS ?t) { ?s ex:p ?o }", "m2") == [("6",)]


def test_construct_blank_nodes_and_infer(quads):
    made = sparql.construct(quads, P + "CONSTRUCT { ?s ex:has [ ex:v ?o ] } WHERE { ?s ex:p ?o }").where("model_id = 'm1'").collect()
    assert len(made) == 8 and len({r.o for r in made if r.o_kind == "bnode"}) == 4
    both = sparql.construct(quads.where("g IS NULL"), P + "CONSTRUCT { ?s ex:new ?o } WHERE { ?s ex:p ?o }", infer=True)
    assert both.where("model_id = 'm1'").count() == 8 + 4


def test_json_rows_type_numbers(quads):
    found = sparql.json_rows(sparql.select(quads, P + "SELECT ?o ?l { ex:a ex:p ?o OPTIONAL { ex:a ex:q ?l FILTER(?o = 1) } }"))
    assert found.where("model_id = 'm1'").first().json == '[{"o":1,"l":"x"},{"o":2}]'


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x WHERE { ?x", "FOO { }", "SELECT ?x { ?x nope:p ?y }"])
def test_errors(text):
    with pytest.raises((SparqlError, IndexError)):
        parse(text)


def test_path_of_a_bare_iri():
    assert parse_path("http://e/p") == ("iri", "http://e/p")
    assert parse_path("<http://e/p>/<http://e/q>")[0] == "seq"
