"""The registered queries over the shared tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo, mapping
from tessera.operators import canonical, closure, enrich, geojson, versions
from tessera.operators import quads as Q
from tessera.plans import rml, sparql
from tessera.sinks import stores, text
from tessera.sources import json_adapters, ldes, messages, rdf_text
from tessera.vocabulary import DCT, GEO, GEOJSON, LOCN, PROV, RDF, RDF_TYPE, TREE, XSD

EX = "https://example.org/ns#"
BASE = "https://example.org/id/"
_PREFIXES = f"PREFIX ex: <{EX}>\nPREFIX xsd: <{XSD}>\nPREFIX dct: <{DCT}>\nPREFIX prov: <{PROV}>\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str, col=F.col):
    return F.concat(F.lit(f"{BASE}{kind}/"), col(key).cast("string"))


def order_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model an order, held as rows: the order, and its customer's segment and nation. An urgent order has a note."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])

    def subjects(c):
        order = {
            EX + "customer": Q.iri(_id("customer", "o_custkey", c)),
            EX + "total": Q.literal(c("o_totalprice").cast("decimal(18,2)").cast("string"), XSD + "decimal"),
            EX + "status": Q.literal(c("o_orderstatus")),
            EX + "date": Q.literal(F.date_format(c("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), XSD + "dateTime"),
            EX + "note": Q.when_literal(c("o_orderpriority") == "1-URGENT", c("o_orderpriority")),
        }
        customer = {EX + "segment": Q.literal(c("c_mktsegment")), EX + "nation": Q.iri(_id("nation", "c_nationkey", c)), EX + "key": Q.literal(c("c_custkey").cast("string"), XSD + "integer")}
        return (_id("order", "o_orderkey", c), order, EX + "Order"), (_id("customer", "o_custkey", c), customer, EX + "Customer")

    wanted = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority", "c_custkey", "c_mktsegment", "c_nationkey")
    return Q.lift_models(rows.select(*wanted), F.col("o_orderkey"), subjects, Q.partitions(orders))


def order_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.statements(order_models(spark, sf_dir))


def nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model: nations, regions, and a made-up chain from each nation to the one before."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = Q.lift(
        nations,
        F.lit("geo"),
        _id("nation", "n_nationkey"),
        {
            EX + "name": Q.literal(F.col("n_name")),
            EX + "region": Q.iri(_id("region", "n_regionkey")),
            EX + "after": Q.iri(F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit(BASE + "nation/"), (F.col("n_nationkey") - 1).cast("string")))),
        },
        EX + "Nation",
    )
    r = Q.lift(regions, F.lit("geo"), _id("region", "r_regionkey"), {EX + "name": Q.literal(F.col("r_name"))}, EX + "Region")
    return Q.union(n, r)


def bgp_select(spark, sf_dir):
    text = _PREFIXES + "SELECT ?o ?seg ?t WHERE { ?o ex:customer ?c ; ex:total ?t . ?c ex:segment ?seg }"
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text), t="decimal(18,2)")


def optional_select(spark, sf_dir):
    text = _PREFIXES + "SELECT ?o ?note WHERE { ?o a ex:Order . OPTIONAL { ?o ex:note ?note } }"
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text))


def filter_compare(spark, sf_dir):
    text = _PREFIXES + 'SELECT ?o (?t * 2 AS ?double) WHERE { ?o ex:total ?t ; ex:status ?s . FILTER(?t > 150000 && ?s IN ("F", "O")) }'
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text), double="double").withColumn("double", F.round("double", 2))


def ask_exists(spark, sf_dir):
    return sparql.ask(order_quads(spark, sf_dir), _PREFIXES + 'ASK { ?o ex:customer ?c . ?c ex:segment "BUILDING" }')


def path_sequence(spark, sf_dir):
    found = sparql.property_path(order_quads(spark, sf_dir), f"<{EX}customer>/<{EX}nation>")
    return found.select("model_id", F.col("subject.v").alias("subject"), F.col("object.v").alias("object"))


def path_star(spark, sf_dir):
    text = _PREFIXES + "SELECT ?a ?b WHERE { ?a a ex:Nation . ?a ex:after* ?b }"
    return sparql.values(sparql.select(nation_quads(spark, sf_dir), text))


def path_plus_alternative(spark, sf_dir):
    text = _PREFIXES + "SELECT ?a ?name WHERE { ?a ex:after+ ?b . ?b (ex:region/ex:name)|ex:name ?name }"
    return sparql.values(sparql.select(nation_quads(spark, sf_dir), text))


def path_inverse(spark, sf_dir):
    text = _PREFIXES + "SELECT ?r ?name WHERE { ?r ^ex:region ?n . ?n ex:name ?name }"
    return sparql.values(sparql.select(nation_quads(spark, sf_dir), text))


def subselect_group_count(spark, sf_dir):
    text = _PREFIXES + "SELECT ?name ?n WHERE { { SELECT ?r (COUNT(?c) AS ?n) WHERE { ?c ex:region ?r } GROUP BY ?r } ?r ex:name ?name }"
    return sparql.values(sparql.select(nation_quads(spark, sf_dir), text), n="bigint")


def aggregates_having(spark, sf_dir):
    q = order_quads(spark, sf_dir).withColumn("model_id", F.lit("all"))
    text = _PREFIXES + "SELECT ?s (COUNT(*) AS ?n) (MIN(?t) AS ?least) (MAX(?t) AS ?most) (AVG(?t) AS ?mean) WHERE { ?o ex:status ?s ; ex:total ?t } GROUP BY ?s HAVING(COUNT(*) > 10)"
    out = sparql.values(sparql.select(q, text), n="bigint", least="decimal(18,2)", most="decimal(18,2)", mean="double")
    return out.withColumn("mean", F.round("mean", 4))


def union_filter_in(spark, sf_dir):
    text = _PREFIXES + 'SELECT ?x ?kind WHERE { { ?x ex:segment ?kind } UNION { ?x ex:status ?kind } FILTER(?kind IN ("BUILDING", "F")) }'
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text))


def bind_functions(spark, sf_dir):
    text = _PREFIXES + """SELECT ?o ?label ?kind ?year WHERE { ?o ex:status ?s ; ex:date ?d .
        BIND(CONCAT(STR(?o), "-", LCASE(?s)) AS ?label) BIND(STR(DATATYPE(?d)) AS ?kind) BIND(YEAR(?d) AS ?year) }"""
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text), year="bigint")


def minus_values(spark, sf_dir):
    text = _PREFIXES + 'SELECT ?o ?s WHERE { VALUES ?s { "F" "P" } ?o ex:status ?s MINUS { ?o ex:note ?n } }'
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text))


def not_exists(spark, sf_dir):
    text = _PREFIXES + "SELECT ?o WHERE { ?o a ex:Order FILTER NOT EXISTS { ?o ex:note ?n } }"
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text))


def distinct_order_limit(spark, sf_dir):
    q = order_quads(spark, sf_dir).withColumn("model_id", F.lit("all"))
    text = _PREFIXES + "SELECT DISTINCT ?c ?k WHERE { ?c ex:key ?k } ORDER BY DESC(?k) LIMIT 7 OFFSET 2"
    return sparql.values(sparql.select(q, text), k="bigint")


def group_concat(spark, sf_dir):
    text = _PREFIXES + 'SELECT ?r (GROUP_CONCAT(?name; SEPARATOR=",") AS ?names) (SUM(STRLEN(?name)) AS ?letters) WHERE { ?n ex:region ?r ; ex:name ?name } GROUP BY ?r'
    return sparql.values(sparql.select(nation_quads(spark, sf_dir), text), letters="bigint")


def service_join(spark, sf_dir):
    text = _PREFIXES + "SELECT ?o ?name WHERE { ?o ex:customer ?c . ?c ex:nation ?n . SERVICE <https://example.org/sparql> { ?n ex:name ?name } }"
    services = {"https://example.org/sparql": nation_quads(spark, sf_dir)}
    return sparql.values(sparql.select(order_quads(spark, sf_dir), text, services))


def construct_triples(spark, sf_dir):
    text = _PREFIXES + 'CONSTRUCT { ?c ex:placed ?o . ?o ex:label ?l } WHERE { ?o ex:customer ?c ; ex:status ?s . BIND(CONCAT("status ", ?s) AS ?l) }'
    return sparql.construct(order_quads(spark, sf_dir), text)


def construct_graph_split(spark, sf_dir):
    text = _PREFIXES + "CONSTRUCT { GRAPH ?r { ?n ex:name ?name } <https://example.org/id/all> a ex:List } WHERE { ?n ex:region ?r ; ex:name ?name }"
    return sparql.construct(nation_quads(spark, sf_dir), text)


def select_json(spark, sf_dir):
    text = _PREFIXES + "SELECT ?k ?seg ?note WHERE { ?o ex:customer ?c . ?c ex:key ?k ; ex:segment ?seg OPTIONAL { ?o ex:note ?note } }"
    return sparql.json_rows(sparql.select(order_quads(spark, sf_dir), text))


def page_quads(spark, sf_dir):
    """One model a region: a page with its nations as members, each with a blank node, and a relation to the next page."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    page, model = _id("page", "n_regionkey"), F.col("n_regionkey")
    blank = lambda key: Q.term(F.concat(F.lit("n"), F.col(key).cast("string")), "bnode")
    member = Q.lift(nations, model, page, {TREE + "member": Q.iri(_id("nation", "n_nationkey"))})
    nation = Q.lift(nations, model, _id("nation", "n_nationkey"), {EX + "name": Q.literal(F.col("n_name")), EX + "detail": blank("n_nationkey")}, EX + "Nation")
    rows = nations.select(model.cast("string").alias("model_id"), "n_nationkey")
    detail = Q.from_terms(rows, blank("n_nationkey"), F.lit(EX + "key"), Q.literal(F.col("n_nationkey").cast("string"), XSD + "integer"))
    links = regions.where("r_regionkey < 4").select(F.col("r_regionkey").cast("string").alias("model_id"), "r_regionkey", (F.col("r_regionkey") + 1).alias("following"))
    relation = Q.term(F.lit("r"), "bnode")
    a = Q.from_terms(links, Q.iri(_id("page", "r_regionkey")), F.lit(TREE + "relation"), relation)
    b = Q.from_terms(links, relation, F.lit(TREE + "node"), Q.iri(_id("page", "following")))
    return Q.union(member, nation, detail, a, b)


def _order_versions(spark, sf_dir):
    return versions.create_version_objects(order_models(spark, sf_dir), [EX + "Order"], [EX + "date"], "#")


def version_object(spark, sf_dir):
    return Q.statements(_order_versions(spark, sf_dir))


def version_materialise(spark, sf_dir):
    return Q.statements(versions.materialise_versions(_order_versions(spark, sf_dir)))


def restrict_to_members(spark, sf_dir):
    return versions.restricted(page_quads(spark, sf_dir))


def member_extraction(spark, sf_dir):
    return ldes.members(page_quads(spark, sf_dir)).select("page", "member_id", "s", "p", "o")


def relation_extraction(spark, sf_dir):
    return ldes.relations(page_quads(spark, sf_dir))


def _arrivals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("member_id"), F.col("o_custkey").alias("version_of"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("arrival_seq"), F.sha2("o_orderstatus", 256).alias("hash"))


def exactly_once(spark, sf_dir):
    return versions.exactly_once(_arrivals(spark, sf_dir)).select("member_id", "arrival_seq")


def latest_state(spark, sf_dir):
    return versions.latest_state(_arrivals(spark, sf_dir)).select("version_of", "ts", "arrival_seq")


def change_detection(spark, sf_dir):
    return versions.changed(_arrivals(spark, sf_dir)).select("member_id", "arrival_seq", "hash")


def member_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_seq"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("member_id"))
    return ldes.member_order(rows)


def skolemise(spark, sf_dir):
    return versions.skolemise(page_quads(spark, sf_dir), "https://example.org/")


def model_hash(spark, sf_dir):
    return canonical.member_hashes(order_quads(spark, sf_dir).where(F.col("p") != EX + "nation").where(F.contains("s", F.lit("/order/"))))


def canonical_hash_blank_nodes(spark, sf_dir):
    """Models with blank nodes, each beside a copy with other labels and one with other statements: the first has its hash, the second hasn't."""
    q = page_quads(spark, sf_dir)
    renamed = lambda c: F.when(F.col(f"{c}_kind") == "bnode", F.concat(F.lit("x"), F.md5(c))).otherwise(F.col(c))
    changed = F.when(F.col("p") == EX + "key", F.concat("o", F.lit("0"))).otherwise(F.col("o"))
    own, alike, other = (canonical.model_hashes(x).select("model_id", F.col("hash").alias(n)) for n, x in (("h", q), ("alike", q.withColumns({"s": renamed("s"), "o": renamed("o")})), ("other", q.withColumn("o", changed))))
    return own.join(alike, "model_id").join(other, "model_id").select("model_id", (F.col("h") == F.col("alike")).alias("same_if_renamed"), (F.col("h") == F.col("other")).alias("same_if_changed"))


def geojson_quads(spark, sf_dir):
    """One model a supplier, with a GeoJSON point whose coordinates are an RDF list."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), _id("supplier", "s_suppkey").alias("id"), (F.col("s_suppkey") % 180).cast("string").alias("x"), F.concat(F.col("s_nationkey").cast("string"), F.lit(".5")).alias("y"))
    b = lambda n: Q.term(F.lit(n), "bnode")
    end = Q.iri(F.lit(RDF + "nil"))
    double = lambda c: Q.literal(F.col(c), XSD + "double")
    parts = [
        (Q.iri(F.col("id")), geojson.GEOMETRY, b("g")),
        (b("g"), RDF_TYPE, Q.iri(F.lit(GEOJSON + "Point"))),
        (b("g"), geojson.COORDINATES, b("c1")),
        (b("c1"), RDF + "first", double("x")),
        (b("c1"), RDF + "rest", b("c2")),
        (b("c2"), RDF + "first", double("y")),
        (b("c2"), RDF + "rest", end),
        (Q.iri(F.col("id")), EX + "kind", Q.literal(F.lit("supplier"))),
    ]
    return Q.union(*[Q.from_terms(s, a, F.lit(p), o) for a, p, o in parts])


def geojson_to_wkt(spark, sf_dir):
    return geojson.geojson_to_wkt(geojson_quads(spark, sf_dir))


def _lines(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("a", (F.col("s_suppkey") % 90).cast("string")).withColumn("b", (F.col("s_suppkey") % 90 + F.col("s_nationkey") % 7 + 1).cast("string"))
    line = F.concat(F.lit("LINESTRING("), "a", F.lit(" 0, "), "b", F.lit(" 0)"))
    multi = F.concat(F.lit("MULTILINESTRING(("), "a", F.lit(" 0, "), "b", F.lit(" 0), (1 2, 3 "), "a", F.lit("))"))
    return s.select("s_suppkey", "a", "b", line.alias("line"), multi.alias("multi"))


def wkt_vertices(spark, sf_dir):
    t = _lines(spark, sf_dir)
    return t.select("s_suppkey", geo.first_coordinate(F.col("line")).alias("first"), geo.last_coordinate(F.col("line")).alias("last"), geo.line_at_index(F.col("multi"), F.lit(1)).alias("second"))


def wkt_geodesics(spark, sf_dir):
    """Lines on the equator, whose lengths are arcs of a circle."""
    t = _lines(spark, sf_dir)
    length = geo.line_length_udf("line")
    return t.select(
        "s_suppkey",
        F.round(length, 3).alias("length"),
        geo.mid_point_udf("line").alias("middle"),
        F.round(geo.distance_from_start_udf("line", geo.last_coordinate(F.col("line"))), 3).alias("distance"),
    )


def wkt_in_sparql(spark, sf_dir):
    """The same functions called by IRI in a query."""
    t = _lines(spark, sf_dir).withColumn("subject", _id("supplier", "s_suppkey"))
    q = Q.lift(t, F.col("s_suppkey"), F.col("subject"), {EX + "line": Q.literal(F.col("line"), GEO + "wktLiteral")})
    text = _PREFIXES + f"PREFIX f: <{geo.NAMESPACE}>\nSELECT ?s ?first ?length WHERE {{ ?s ex:line ?l BIND(f:firstCoordinate(?l) AS ?first) BIND(f:lineLength(?l) AS ?length) }}"
    out = sparql.values(sparql.select(q, text), length="double")
    return out.withColumn("length", F.round("length", 3))


def to_wkt_function(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    pair = F.concat(F.col("s_suppkey").cast("string"), F.lit(",5 "), F.col("s_nationkey").cast("string"))
    return t.select("s_suppkey", mapping.to_wkt(pair, F.lit("POINT")).alias("point"), mapping.to_wkt(F.concat(pair, F.lit(" 7 8,25")), F.lit("LINESTRING")).alias("line"))


def epoch_iso(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return t.select("event_id", mapping.epoch_to_iso8601(F.col("event_id") * 1000).alias("iso"), mapping.replace(F.col("event_type"), F.lit("c"), F.lit("-")).alias("replaced"))


def ngsi_id_rewrite(spark, sf_dir):
    t = table(spark, sf_dir, "orders").withColumn("id", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("urn:x:"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")))
    return t.select("o_orderkey", mapping.ngsi_id(F.col("id"), F.lit("Order")).alias("ngsi_id"), mapping.ngsi_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("date"))


def ngsi_key_rename(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in ("dateCreated", "dateModified", "timestamp", "geo:json", "Reference", "other")])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(keys).alias("key")).withColumn("name", mapping.ngsi_name(F.col("key")))


def ngsi_attributes(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    attribute = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    held = F.create_map(F.lit("name"), attribute("Text", F.col("n_name")), F.lit("region"), attribute("Reference", _id("region", "n_regionkey")), F.lit("timestamp"), attribute("DateTime", F.lit("2024-01-01T00:00:00")))
    return json_adapters.ngsi_attributes(t, F.col("n_nationkey"), F.col("n_nationkey").cast("string"), F.lit("Nation"), held, EX).select("model_id", "s_kind", "p", "o", "o_kind", "o_dt").where(F.col("o_kind") != "bnode")


def _event_messages(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    item = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.array("event_type", F.lit("all")).alias("tags"))
    return t.select(F.col("event_id").cast("string").alias("model_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("content"), F.lit("application/json").alias("mime_type"))


RML_MAPPING = f"""@prefix rr: <{rml.RR}> . @prefix rml: <{rml.RML}> . @prefix ql: <{rml.QL}> . @prefix ex: <{EX}> .
ex:Map rml:logicalSource [ rml:referenceFormulation ql:JSONPath ; rml:iterator "$.items[*]" ] ;
  rr:subjectMap [ rr:template "{BASE}event/{{id}}" ; rr:class ex:Event ] ;
  rr:predicateObjectMap [ rr:predicate ex:user ; rr:objectMap [ rr:template "{BASE}user/{{user}}" ] ] ,
    [ rr:predicate ex:tag ; rr:objectMap [ rml:reference "tags[*]" ; rr:language "en" ] ] ."""


def rml_json(spark, sf_dir):
    return rml.apply_mapping(_event_messages(spark, sf_dir), RML_MAPPING)


def json_to_ld(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    content = F.to_json(F.array(F.struct(_id("nation", "n_nationkey").alias("@id"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region"))))
    messages_ = t.select(F.col("n_nationkey").cast("string").alias("model_id"), content.alias("content"), F.lit("application/json").alias("mime_type"))
    return json_adapters.json_to_ld(messages_, {"@vocab": EX}).select("model_id", "s_kind", "p", "o_kind", "o_dt", F.when(F.col("o_kind") != "bnode", F.col("o")).alias("o"))


def nquads_serialise(spark, sf_dir):
    return text.nquads(order_models(spark, sf_dir))


def nquads_round_trip(spark, sf_dir):
    written = text.nquads(order_models(spark, sf_dir)).withColumn("mime_type", F.lit("application/n-quads"))
    return rdf_text.adapt(written, whole_models=True)


def literal_round_trip(spark, sf_dir):
    """Whole texts of documents as literals, written as N-Quads and read back."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    q = Q.lift(docs, F.col("doc_id"), _id("document", "doc_id"), {EX + "text": Q.literal(F.col("text"))})
    back = rdf_text.adapt(text.nquads(q).withColumn("mime_type", F.lit("application/n-quads")), whole_models=True)
    return back.select("model_id", "s", "p", F.md5("o").alias("o"), "o_dt")


def turtle_round_trip(spark, sf_dir):
    written = text.serialise(order_models(spark, sf_dir), "text/turtle").withColumn("mime_type", F.lit("text/turtle"))
    return rdf_text.adapt(written, whole_models=True)


def json_ld_round_trip(spark, sf_dir):
    written = text.serialise(order_models(spark, sf_dir), "application/ld+json").withColumn("mime_type", F.lit("application/ld+json"))
    return rdf_text.adapt(written, whole_models=True)


def http_enrich_lookup(spark, sf_dir):
    """Orders enriched with what the URL of their customer's nation answers, by a fetch that looks 25 answers up."""
    answers = {f"{BASE}nation/{r.n_nationkey}": f'<{BASE}nation/{r.n_nationkey}> <{EX}name> "{r.n_name}" .' for r in table(spark, sf_dir, "nation").collect()}

    def fetch(method, url, body, headers):
        return (200, "application/n-quads", answers[url]) if method == "GET" and url in answers else (404, "text/plain", "")

    out = enrich.http_enrich(order_quads(spark, sf_dir), fetch, f"<{EX}customer>/<{EX}nation>")
    return out.where(F.col("p") == EX + "name").select("model_id", "s", "o")


def table_enrich_lookup(spark, sf_dir):
    out = enrich.table_enrich(order_quads(spark, sf_dir), nation_quads(spark, sf_dir), f"<{EX}customer>/<{EX}nation>")
    return out.where(F.col("p") == EX + "name").select("model_id", "s", "o")


def graph_closure(spark, sf_dir):
    q = nation_quads(spark, sf_dir)
    roots = q.where(F.col("p") == EX + "after").select("model_id", F.col("s").alias("root")).distinct()
    return closure.subgraph(q, roots).select("root", "s", "p", "o")


def structure_counts(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select((F.col("n_nationkey") - 1).alias("parent"), F.col("n_nationkey").alias("child"))
    return ldes.structure_counts(edges)


def sink_upsert(spark, sf_dir):
    store = nation_quads(spark, sf_dir)
    changed = store.where((F.col("p") == EX + "name") & F.contains("s", F.lit("/nation/"))).where(F.length("s") % 2 == 0).withColumn("o", F.lower("o")).withColumn("model_id", F.lit("new"))
    return stores.upsert(store, changed)


def rdb_select(spark, sf_dir):
    query = _PREFIXES + "SELECT ?k ?seg ?total ?date WHERE { ?o ex:customer ?c ; ex:total ?total ; ex:date ?date . ?c ex:key ?k ; ex:segment ?seg }"
    return stores.select_rows(order_quads(spark, sf_dir), query, {"k": "bigint", "total": "decimal(18,2)"})


def sparql_update_text(spark, sf_dir):
    q = nation_quads(spark, sf_dir).where((F.col("p") == EX + "name")).withColumn("model_id", F.col("s"))
    return stores.update_text(q, stores.delete_where(1))


def archive_path(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("model_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return stores.with_archive_paths(t).select("model_id", "path")


def blob_name(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", stores.blob_name(_id("order", "o_orderkey"), "ttl").alias("blob"))


def page_dedup(spark, sf_dir):
    fetched = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("member_id"))
    return ldes.page_dedup(fetched.where("member_id % 3 = 0"), fetched)


def mutability_parse(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "public, immutable, max-age=604800").when(F.col("event_id") % 3 == 1, F.concat(F.lit("max-age="), F.col("event_id").cast("string"))).alias("h"))
    mutable, age = ldes.mutability(F.col("h"))
    return t.select("event_id", mutable.alias("mutable"), age.alias("max_age"))


def frontier_next(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(_id("order", "o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "IMMUTABLE_WITH_UNPROCESSED_MEMBERS").when(F.col("o_orderstatus") == "O", "MUTABLE_AND_ACTIVE").otherwise("NOT_VISITED").alias("status"), F.col("o_orderdate").alias("earliest_next_visit"))
    return ldes.next_nodes(t, 10000).select("url", "status")


def kafka_messages(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    headers = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("Content-Type").alias("key"), F.lit("text/turtle").cast("binary").alias("value"))))
    records = t.select(F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("event_type").cast("binary").alias("value"), headers.alias("headers"))
    return messages.kafka_messages(records)


def describe_node(spark, sf_dir):
    return sparql.construct(page_quads(spark, sf_dir), _PREFIXES + "DESCRIBE ?n WHERE { ?n a ex:Nation }").select("model_id", "s", "p", "o")


def route_ask(spark, sf_dir):
    yes, no = sparql.route(order_models(spark, sf_dir), _PREFIXES + "ASK { ?o ex:note ?n }")
    return yes.select("model_id").distinct().withColumn("route", F.lit("true")).unionByName(no.select("model_id").distinct().withColumn("route", F.lit("false")))


_ORD = f"""o AS (SELECT o_orderkey::VARCHAR AS model_id, '{BASE}order/' || o_orderkey AS o, '{BASE}customer/' || o_custkey AS c, o_custkey AS ck,
  o_totalprice::DECIMAL(18,2) AS t, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS d, c_mktsegment AS seg, c_nationkey AS nk,
  '{BASE}nation/' || c_nationkey AS n, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END AS note FROM orders JOIN customer ON o_custkey = c_custkey)"""

_SQL: dict[str, str] = {
    "bgp_select": f"WITH {_ORD} SELECT model_id, o, seg, t FROM o",
    "optional_select": f"WITH {_ORD} SELECT model_id, o, note FROM o",
    "filter_compare": f"WITH {_ORD} SELECT model_id, o, round(t::DOUBLE * 2, 2) AS double FROM o WHERE t > 150000 AND s IN ('F', 'O')",
    "ask_exists": f"WITH {_ORD} SELECT model_id, seg = 'BUILDING' AS answer FROM o",
    "path_sequence": f"WITH {_ORD} SELECT model_id, o AS subject, n AS object FROM o",
    "path_star": f"""WITH RECURSIVE r AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION SELECT r.a, b - 1 FROM r WHERE b % 5 <> 0)
        SELECT 'geo' AS model_id, '{BASE}nation/' || a AS a, '{BASE}nation/' || b AS b FROM r""",
    "path_plus_alternative": f"""WITH RECURSIVE r AS (SELECT n_nationkey AS a, n_nationkey - 1 AS b FROM nation WHERE n_nationkey % 5 <> 0 UNION SELECT r.a, b - 1 FROM r WHERE b % 5 <> 0)
        SELECT 'geo' AS model_id, '{BASE}nation/' || a AS a, n_name AS name FROM r JOIN nation ON n_nationkey = b
        UNION ALL SELECT 'geo', '{BASE}nation/' || a, r_name FROM r JOIN nation ON n_nationkey = b JOIN region ON r_regionkey = n_regionkey""",
    "path_inverse": f"SELECT 'geo' AS model_id, '{BASE}region/' || n_regionkey AS r, n_name AS name FROM nation",
    "subselect_group_count": "SELECT 'geo' AS model_id, r_name AS name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "aggregates_having": f"WITH {_ORD} SELECT 'all' AS model_id, s, count(*) AS n, min(t) AS least, max(t) AS most, round(avg(t::DOUBLE), 4) AS mean FROM o GROUP BY s HAVING count(*) > 10",
    "union_filter_in": f"WITH {_ORD} SELECT model_id, c AS x, seg AS kind FROM o WHERE seg IN ('BUILDING', 'F') UNION ALL SELECT model_id, o, s FROM o WHERE s IN ('BUILDING', 'F')",
    "bind_functions": f"WITH {_ORD} SELECT model_id, o, o || '-' || lower(s) AS label, '{XSD}dateTime' AS kind, substr(d, 1, 4)::BIGINT AS year FROM o",
    "minus_values": f"WITH {_ORD} SELECT model_id, o, s FROM o WHERE s IN ('F', 'P') AND note IS NULL",
    "not_exists": f"WITH {_ORD} SELECT model_id, o FROM o WHERE note IS NULL",
    "distinct_order_limit": f"WITH {_ORD} SELECT DISTINCT 'all' AS model_id, c, ck::BIGINT AS k FROM o ORDER BY k DESC LIMIT 7 OFFSET 2",
    "group_concat": f"SELECT 'geo' AS model_id, '{BASE}region/' || n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS names, sum(length(n_name))::BIGINT AS letters FROM nation GROUP BY n_regionkey",
    "service_join": f"WITH {_ORD} SELECT model_id, o, n_name AS name FROM o JOIN nation ON n_nationkey = nk",
    "construct_triples": f"""WITH {_ORD} SELECT model_id, NULL::VARCHAR AS g, c AS s, 'iri' AS s_kind, '{EX}placed' AS p, o, 'iri' AS o_kind, NULL::VARCHAR AS o_dt, NULL::VARCHAR AS o_lang FROM o
        UNION ALL SELECT model_id, NULL, o, 'iri', '{EX}label', 'status ' || s, 'literal', '{XSD}string', NULL FROM o""",
    "construct_graph_split": f"""WITH n AS (SELECT 'geo#graph={BASE}region/' || n_regionkey AS model_id, '{BASE}nation/' || n_nationkey AS s, n_name FROM nation)
        SELECT model_id, NULL::VARCHAR AS g, s, 'iri' AS s_kind, '{EX}name' AS p, n_name AS o, 'literal' AS o_kind, '{XSD}string' AS o_dt, NULL::VARCHAR AS o_lang FROM n
        UNION SELECT model_id, NULL, '{BASE}all', 'iri', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{EX}List', 'iri', NULL, NULL FROM n""",
    "select_json": f"""WITH {_ORD} SELECT model_id, '[{{"k":' || ck || ',"seg":"' || seg || '"' || coalesce(',"note":"' || note || '"', '') || '}}]' AS json FROM o""",
}


_Q = f"""{_ORD}, q AS (
  SELECT model_id, o AS s, '{RDF_TYPE}' AS p, '{EX}Order' AS o, 'iri' AS o_kind, NULL AS o_dt FROM o
  UNION ALL SELECT model_id, o, '{EX}customer', c, 'iri', NULL FROM o
  UNION ALL SELECT model_id, o, '{EX}total', t::VARCHAR, 'literal', '{XSD}decimal' FROM o
  UNION ALL SELECT model_id, o, '{EX}status', s, 'literal', '{XSD}string' FROM o
  UNION ALL SELECT model_id, o, '{EX}date', d, 'literal', '{XSD}dateTime' FROM o
  UNION ALL SELECT model_id, o, '{EX}note', note, 'literal', '{XSD}string' FROM o WHERE note IS NOT NULL
  UNION ALL SELECT model_id, c, '{RDF_TYPE}', '{EX}Customer', 'iri', NULL FROM o
  UNION ALL SELECT model_id, c, '{EX}segment', seg, 'literal', '{XSD}string' FROM o
  UNION ALL SELECT model_id, c, '{EX}nation', n, 'iri', NULL FROM o
  UNION ALL SELECT model_id, c, '{EX}key', ck::VARCHAR, 'literal', '{XSD}integer' FROM o)"""
_ALL = "model_id, NULL::VARCHAR AS g, s, 'iri' AS s_kind, p, o, o_kind, o_dt, NULL::VARCHAR AS o_lang"
_NQ = f"""'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '"' || o || '"' || CASE WHEN o_dt <> '{XSD}string' THEN '^^<' || o_dt || '>' ELSE '' END END || ' .'"""
_NATION = f"""q AS (SELECT 'geo' AS model_id, '{BASE}nation/' || n_nationkey AS s, '{RDF_TYPE}' AS p, '{EX}Nation' AS o, 'iri' AS o_kind, NULL AS o_dt FROM nation
  UNION ALL SELECT 'geo', '{BASE}nation/' || n_nationkey, '{EX}name', n_name, 'literal', '{XSD}string' FROM nation
  UNION ALL SELECT 'geo', '{BASE}nation/' || n_nationkey, '{EX}region', '{BASE}region/' || n_regionkey, 'iri', NULL FROM nation
  UNION ALL SELECT 'geo', '{BASE}nation/' || n_nationkey, '{EX}after', '{BASE}nation/' || (n_nationkey - 1), 'iri', NULL FROM nation WHERE n_nationkey % 5 <> 0
  UNION ALL SELECT 'geo', '{BASE}region/' || r_regionkey, '{RDF_TYPE}', '{EX}Region', 'iri', NULL FROM region
  UNION ALL SELECT 'geo', '{BASE}region/' || r_regionkey, '{EX}name', r_name, 'literal', '{XSD}string' FROM region)"""
_PAGE = f"""q AS (SELECT n_regionkey::VARCHAR AS model_id, '{BASE}page/' || n_regionkey AS s, 'iri' AS s_kind, '{TREE}member' AS p, '{BASE}nation/' || n_nationkey AS o, 'iri' AS o_kind, NULL AS o_dt, n_nationkey AS n FROM nation
  UNION ALL SELECT n_regionkey::VARCHAR, '{BASE}nation/' || n_nationkey, 'iri', '{RDF_TYPE}', '{EX}Nation', 'iri', NULL, n_nationkey FROM nation
  UNION ALL SELECT n_regionkey::VARCHAR, '{BASE}nation/' || n_nationkey, 'iri', '{EX}name', n_name, 'literal', '{XSD}string', n_nationkey FROM nation
  UNION ALL SELECT n_regionkey::VARCHAR, '{BASE}nation/' || n_nationkey, 'iri', '{EX}detail', 'n' || n_nationkey, 'bnode', NULL, n_nationkey FROM nation
  UNION ALL SELECT n_regionkey::VARCHAR, 'n' || n_nationkey, 'bnode', '{EX}key', n_nationkey::VARCHAR, 'literal', '{XSD}integer', n_nationkey FROM nation
  UNION ALL SELECT r_regionkey::VARCHAR, '{BASE}page/' || r_regionkey, 'iri', '{TREE}relation', 'r', 'bnode', NULL, NULL FROM region WHERE r_regionkey < 4
  UNION ALL SELECT r_regionkey::VARCHAR, 'r', 'bnode', '{TREE}node', '{BASE}page/' || (r_regionkey + 1), 'iri', NULL, NULL FROM region WHERE r_regionkey < 4)"""
_LINE = """t AS (SELECT s_suppkey, (s_suppkey % 90)::VARCHAR AS a, (s_suppkey % 90 + s_nationkey % 7 + 1)::VARCHAR AS b, s_nationkey % 7 + 1 AS d FROM supplier)"""

_SQL |= {
    "version_object": f"""WITH {_Q} SELECT model_id, NULL::VARCHAR AS g, CASE WHEN q.s LIKE '%/order/%' THEN q.s || '#' || d ELSE q.s END AS s, 'iri' AS s_kind, p, q.o, o_kind, o_dt, NULL::VARCHAR AS o_lang
        FROM q JOIN (SELECT model_id, d FROM o) USING (model_id)
        UNION ALL SELECT model_id, NULL, o || '#' || d, 'iri', '{PROV}generatedAtTime', d, 'literal', '{XSD}dateTime', NULL FROM o
        UNION ALL SELECT model_id, NULL, o || '#' || d, 'iri', '{DCT}isVersionOf', o, 'iri', NULL, NULL FROM o""",
    "version_materialise": f"""WITH {_Q} SELECT {_ALL} FROM q
        UNION ALL SELECT model_id, NULL, o, 'iri', '{PROV}generatedAtTime', d, 'literal', '{XSD}dateTime', NULL FROM o""",
    "restrict_to_members": f"WITH {_PAGE} SELECT model_id, NULL::VARCHAR AS g, s, s_kind, p, o, o_kind, o_dt, NULL::VARCHAR AS o_lang FROM q WHERE s LIKE '%/nation/%' OR p = '{EX}key'",
    "member_extraction": f"WITH {_PAGE} SELECT model_id AS page, '{BASE}nation/' || n AS member_id, s, p, o FROM q WHERE s LIKE '%/nation/%' OR p = '{EX}key'",
    "relation_extraction": f"WITH {_PAGE} SELECT model_id, o AS node FROM q WHERE p = '{TREE}node'",
    "exactly_once": "SELECT o_custkey AS member_id, min(o_orderkey) AS arrival_seq FROM orders GROUP BY 1",
    "latest_state": """SELECT o_custkey AS version_of, o_orderdate AS ts, o_orderkey AS arrival_seq FROM orders
        QUALIFY coalesce(o_orderdate > max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)""",
    "change_detection": """SELECT o_custkey AS member_id, o_orderkey AS arrival_seq, sha256(o_orderstatus) AS hash FROM orders
        QUALIFY coalesce(o_orderstatus <> lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true)""",
    "member_order": "SELECT o_custkey AS page_seq, o_orderdate AS created_at, o_orderkey AS member_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS position FROM orders",
    "skolemise": f"""WITH {_PAGE} SELECT model_id, NULL::VARCHAR AS g, CASE WHEN s_kind = 'bnode' THEN 'https://example.org/.well-known/genid/' || sha256(model_id || chr(31) || s) ELSE s END AS s, 'iri' AS s_kind, p,
        CASE WHEN o_kind = 'bnode' THEN 'https://example.org/.well-known/genid/' || sha256(model_id || chr(31) || o) ELSE o END AS o, CASE WHEN o_kind = 'bnode' THEN 'iri' ELSE o_kind END AS o_kind, o_dt, NULL::VARCHAR AS o_lang FROM q""",
    "model_hash": f"""WITH {_Q} SELECT model_id, s AS member_id, sha256(string_agg({_NQ}, chr(10) ORDER BY {_NQ}) || chr(10)) AS hash FROM q WHERE s LIKE '%/order/%' GROUP BY ALL""",
    "canonical_hash_blank_nodes": "SELECT r_regionkey::VARCHAR AS model_id, true AS same_if_renamed, false AS same_if_changed FROM region",
    "geojson_to_wkt": f"""SELECT s_suppkey::VARCHAR AS model_id, NULL::VARCHAR AS g, '{BASE}supplier/' || s_suppkey AS s, 'iri' AS s_kind, '{LOCN}geometry' AS p, 'POINT (' || s_suppkey % 180 || ' ' || s_nationkey || '.5)' AS o, 'literal' AS o_kind, '{GEO}wktLiteral' AS o_dt, NULL::VARCHAR AS o_lang FROM supplier
        UNION ALL SELECT s_suppkey::VARCHAR, NULL, '{BASE}supplier/' || s_suppkey, 'iri', '{EX}kind', 'supplier', 'literal', '{XSD}string', NULL FROM supplier""",
    "wkt_vertices": f"WITH {_LINE} SELECT s_suppkey, 'POINT(' || a || ' 0)' AS first, 'POINT(' || b || ' 0)' AS last, 'LINESTRING(1 2, 3 ' || a || ')' AS second FROM t",
    "wkt_geodesics": f"""WITH {_LINE} SELECT s_suppkey, round(6378137.0 * radians(d), 3) AS length, 'POINT(' || CASE WHEN d % 2 = 0 THEN (a::INT + d // 2)::VARCHAR ELSE (a::INT + d // 2)::VARCHAR || '.5' END || ' 0)' AS middle, round(6378137.0 * radians(d), 3) AS distance FROM t""",
    "wkt_in_sparql": f"WITH {_LINE} SELECT s_suppkey::VARCHAR AS model_id, '{BASE}supplier/' || s_suppkey AS s, 'POINT(' || a || ' 0)' AS first, round(6378137.0 * radians(d), 3) AS length FROM t",
    "to_wkt_function": "SELECT s_suppkey, '<http://www.opengis.net/def/crs/OGC/1.3/CRS84>POINT(' || s_suppkey || '.5 ' || s_nationkey || ')' AS point, '<http://www.opengis.net/def/crs/OGC/1.3/CRS84>LINESTRING(' || s_suppkey || '.5 ' || s_nationkey || ',7 8.25)' AS line FROM supplier",
    "epoch_iso": "SELECT event_id, strftime(make_timestamp(event_id * 1000 * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, replace(event_type, 'c', '-') AS replaced FROM events",
    "ngsi_id_rewrite": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'urn:x:' || o_orderkey ELSE 'urn:ngsi-ld:Order:' || o_orderkey END AS ngsi_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS date FROM orders",
    "ngsi_key_rename": """SELECT n_nationkey, key, name FROM nation CROSS JOIN (VALUES ('dateCreated', 'createdAt'), ('dateModified', 'modifiedAt'), ('timestamp', 'observedAt'), ('geo:json', 'GeoProperty'), ('Reference', 'Relationship'), ('other', 'other')) v(key, name)""",
    "ngsi_attributes": f"""WITH a AS (SELECT n_nationkey::VARCHAR AS model_id, * FROM nation) SELECT model_id, 'bnode' AS s_kind, '{EX}type' AS p, k AS o, 'literal' AS o_kind, '{XSD}string' AS o_dt FROM a CROSS JOIN (VALUES ('Property'), ('Property'), ('Relationship')) v(k)
        UNION ALL SELECT model_id, 'bnode', '{EX}value', n_name, 'literal', '{XSD}string' FROM a
        UNION ALL SELECT model_id, 'bnode', '{EX}value', '2024-01-01T00:00:00Z', 'literal', '{XSD}dateTime' FROM a
        UNION ALL SELECT model_id, 'bnode', '{EX}object', '{BASE}region/' || n_regionkey, 'iri', NULL FROM a""",
    "rml_json": f"""SELECT event_id::VARCHAR AS model_id, NULL::VARCHAR AS g, '{BASE}event/' || event_id AS s, 'iri' AS s_kind, '{RDF_TYPE}' AS p, '{EX}Event' AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_dt, NULL::VARCHAR AS o_lang FROM events
        UNION ALL SELECT event_id::VARCHAR, NULL, '{BASE}event/' || event_id, 'iri', '{EX}user', '{BASE}user/' || user_id, 'iri', NULL, NULL FROM events
        UNION ALL SELECT event_id::VARCHAR, NULL, '{BASE}event/' || event_id, 'iri', '{EX}tag', v, 'literal', '{RDF}langString', 'en' FROM (SELECT event_id, unnest([event_type, 'all']) AS v FROM events)""",
    "json_to_ld": f"""SELECT n_nationkey::VARCHAR AS model_id, 'iri' AS s_kind, '{EX}name' AS p, 'literal' AS o_kind, '{XSD}string' AS o_dt, n_name AS o FROM nation
        UNION ALL SELECT n_nationkey::VARCHAR, 'iri', '{EX}region', 'bnode', NULL, NULL FROM nation
        UNION ALL SELECT n_nationkey::VARCHAR, 'bnode', '{EX}key', 'literal', '{XSD}integer', n_regionkey::VARCHAR FROM nation""",
    "nquads_serialise": f"WITH {_Q} SELECT model_id, string_agg({_NQ}, chr(10) ORDER BY {_NQ}) || chr(10) AS content FROM q GROUP BY model_id",
    "literal_round_trip": f"SELECT DISTINCT doc_id::VARCHAR AS model_id, '{BASE}document/' || doc_id AS s, '{EX}text' AS p, md5(text) AS o, '{XSD}string' AS o_dt FROM documents WHERE text IS NOT NULL",
    **{name: f"WITH {_Q} SELECT {_ALL} FROM q" for name in ("nquads_round_trip", "turtle_round_trip", "json_ld_round_trip")},
    **{name: f"WITH {_ORD} SELECT model_id, n AS s, n_name AS o FROM o JOIN nation ON n_nationkey = nk" for name in ("http_enrich_lookup", "table_enrich_lookup")},
    "graph_closure": f"""WITH RECURSIVE {_NATION}, r AS (SELECT DISTINCT s AS root, s AS node FROM q WHERE p = '{EX}after' UNION SELECT r.root, q.o FROM r JOIN q ON q.s = r.node AND q.o_kind = 'iri')
        SELECT root, s, p, o FROM r JOIN q ON q.s = r.node""",
    "structure_counts": """WITH RECURSIVE e AS (SELECT n_nationkey - 1 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey % 5 <> 0),
        r AS (SELECT parent, child FROM e UNION SELECT r.parent, e.child FROM r JOIN e ON e.parent = r.child)
        SELECT r.parent, max(d.n) AS direct, count(*) AS total FROM r JOIN (SELECT parent, count(*) AS n FROM e GROUP BY 1) d USING (parent) GROUP BY 1""",
    "sink_upsert": f"""WITH {_NATION}, c AS (SELECT s, o FROM q WHERE p = '{EX}name' AND s LIKE '%/nation/%' AND length(s) % 2 = 0)
        SELECT {_ALL} FROM q WHERE s NOT IN (SELECT s FROM c) UNION ALL SELECT 'new', NULL, s, 'iri', '{EX}name', lower(o), 'literal', '{XSD}string', NULL FROM c""",
    "rdb_select": f"WITH {_ORD} SELECT ck::BIGINT AS k, seg, t AS total, d AS date FROM o",
    "sparql_update_text": f"""WITH {_NATION} SELECT s AS model_id, 'DELETE {{ ?node ?property ?value }} WHERE {{ VALUES ?root {{ <' || s || '> }} ?root (a|!a)? ?node . ?node ?property ?value }} ;' || chr(10) || 'INSERT DATA {{ ' || {_NQ} || ' }}' AS content FROM q WHERE p = '{EX}name'""",
    "archive_path": """SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS model_id, strftime(o_orderdate, '%Y/%m/%d/%Y-%m-%d-%H-%M-%S-%f') || '000' || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END || '.ttl' AS path
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS n FROM orders)""",
    "blob_name": f"SELECT o_orderkey, replace('{BASE}order/' || o_orderkey || '.ttl', '/', '_') AS blob FROM orders",
    "page_dedup": "SELECT o_custkey AS page, o_orderkey AS member_id FROM orders WHERE o_orderkey % 3 <> 0",
    "mutability_parse": "SELECT event_id, event_id % 3 <> 0 AS mutable, CASE event_id % 3 WHEN 0 THEN 604800 WHEN 1 THEN event_id ELSE 60 END::BIGINT AS max_age FROM events",
    "frontier_next": f"""SELECT url, status FROM (SELECT '{BASE}order/' || o_orderkey AS url, CASE o_orderstatus WHEN 'F' THEN 'IMMUTABLE_WITH_UNPROCESSED_MEMBERS' WHEN 'O' THEN 'MUTABLE_AND_ACTIVE' ELSE 'NOT_VISITED' END AS status, o_orderdate FROM orders)
        ORDER BY CASE status WHEN 'IMMUTABLE_WITH_UNPROCESSED_MEMBERS' THEN 0 WHEN 'NOT_VISITED' THEN 1 ELSE 2 END, CASE WHEN status = 'MUTABLE_AND_ACTIVE' THEN o_orderdate END NULLS FIRST, url LIMIT 10000""",
    "kafka_messages": "SELECT 'events-0-' || event_id AS model_id, event_type AS content, CASE WHEN event_id % 2 = 0 THEN 'text/turtle' ELSE 'application/n-quads' END AS mime_type FROM events",
    "describe_node": f"WITH {_PAGE} SELECT model_id, s, p, o FROM q WHERE s LIKE '%/nation/%' OR p = '{EX}key'",
    "route_ask": f"WITH {_ORD} SELECT model_id, (note IS NOT NULL)::VARCHAR AS route FROM o",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
