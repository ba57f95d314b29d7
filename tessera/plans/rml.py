"""RML mappings compiled to DataFrame plans.

A mapping's triples maps become one table of logical rows each (JSON by variant paths inside the
JVM; XML and CSV by small parsers) and one projection for all their statements. Joins between
triples maps stay inside a message.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.functions import mapping as functions
from tessera.operators.closure import subgraph
from tessera.operators.quads import COLUMNS, as_set, from_terms, literal, term, union
from tessera.plans.sparql import graphs_to_models
from tessera.sources.rdf_text import parse_turtle
from tessera.vocabulary import LANG_STRING, RDF_TYPE, XSD_STRING

RML, RR, QL, FNML, FNO = "http://semweb.mmlab.be/ns/rml#", "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/ql#", "http://semweb.mmlab.be/ns/fnml#", "https://w3id.org/function/ontology#"
#: FnO functions by local name, whatever the namespace: local names of the parameters in order, and the expression.
FUNCTIONS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "replace": (("content", "target", "replacement"), functions.replace),
    "toWkt": (("coordinates", "wktType"), functions.to_wkt),
    "epochToIso8601": (("epoch",), functions.epoch_to_iso8601),
}


def local_name(iri: str) -> str:
    return re.split(r"[#/]", iri)[-1]


def register_function(name: str, parameters: tuple[str, ...], expression: Callable[..., Column]) -> None:
    FUNCTIONS[name] = (parameters, expression)


@dataclass
class TermMap:
    kind: str  # reference, template, constant, function
    value: object
    term_type: str
    datatype: str | None = None
    language: str | None = None


@dataclass
class TriplesMap:
    name: str
    formulation: str
    iterator: str | None
    subject: TermMap
    classes: list[str]
    graphs: list[TermMap]
    properties: list[tuple[list[TermMap], list, list[TermMap]]] = field(default_factory=list)


class Mapping:
    """The triples maps of a mapping document in Turtle."""

    def __init__(self, text: str):
        self.g: dict[str, dict[str, list[tuple[str, str]]]] = defaultdict(lambda: defaultdict(list))
        for _, s, _, p, o, kind, _, lang in parse_turtle(text):
            self.g[s][p].append((o, lang or "") if kind == "literal" else (o, kind))
        names = [s for s in self.g if RML + "logicalSource" in self.g[s]]
        self.maps = {n: self.triples_map(n) for n in names}

    def one(self, node: str, p: str) -> str | None:
        found = self.g[node].get(p)
        return found[0][0] if found else None

    def term_map(self, node: str, default: str) -> TermMap:
        kind, value = next(((k, self.one(node, p)) for k, p in (("constant", RR + "constant"), ("template", RR + "template"), ("reference", RML + "reference"), ("reference", RR + "column")) if self.one(node, p) is not None), (None, None))
        explicit = (self.one(node, RR + "termType") or "").removeprefix(RR)
        datatype, language = self.one(node, RR + "datatype"), self.one(node, RR + "language")
        if kind is None:
            if (f := self.one(node, FNML + "functionValue")) is None:
                raise ValueError(f"no value in term map {node}")
            kind, value = "function", self.function(f)
        if explicit:
            term_type = {"IRI": "iri", "BlankNode": "bnode", "Literal": "literal"}[explicit]
        elif kind == "constant":
            shape = self.g[node][RR + "constant"][0][1]
            term_type = shape if shape in ("iri", "bnode") else "literal"
        elif default == "object":
            term_type = "iri" if kind == "template" and not datatype and not language else "literal"
        else:
            term_type = "iri"
        return TermMap(kind, value, term_type, datatype, language)

    def function(self, node: str) -> tuple[str, dict[str, TermMap]]:
        name, arguments = None, {}
        for pom, _ in self.g[node][RR + "predicateObjectMap"]:
            predicate = self.one(pom, RR + "predicate") or self.term_map(self.one(pom, RR + "predicateMap"), "iri").value
            found = self.one(pom, RR + "objectMap")
            m = self.term_map(found, "object") if found else TermMap("constant", self.one(pom, RR + "object"), "literal")
            if predicate == FNO + "executes":
                name = m.value
            else:
                arguments[predicate] = m
        return name, arguments

    def several(self, node: str, shortcut: str, full: str, default: str) -> list:
        out = []
        for o, kind in self.g[node].get(RR + shortcut, []):
            out.append(TermMap("constant", o, kind if kind in ("iri", "bnode") else "literal", None, kind if kind not in ("iri", "bnode") else None))
        for o, _ in self.g[node].get(RR + full, []):
            parent = self.one(o, RR + "parentTriplesMap")
            if parent:
                joins = [(self.one(j, RR + "child"), self.one(j, RR + "parent")) for j, _ in self.g[o].get(RR + "joinCondition", [])]
                out.append((parent, joins))
            else:
                out.append(self.term_map(o, default))
        return out

    def triples_map(self, name: str) -> TriplesMap:
        source, subject = self.one(name, RML + "logicalSource"), self.one(name, RR + "subjectMap")
        s = self.term_map(subject, "iri") if subject else TermMap("constant", self.one(name, RR + "subject"), "iri")
        formulation = (self.one(source, RML + "referenceFormulation") or QL + "CSV").removeprefix(QL)
        out = TriplesMap(name, formulation, self.one(source, RML + "iterator"), s, [o for o, _ in self.g[subject].get(RR + "class", [])] if subject else [], self.several(subject, "graph", "graphMap", "iri") if subject else [])
        for pom, _ in self.g[name].get(RR + "predicateObjectMap", []):
            out.properties.append((self.several(pom, "predicate", "predicateMap", "iri"), self.several(pom, "object", "objectMap", "object"), self.several(pom, "graph", "graphMap", "iri")))
        return out

    def references(self, m: TermMap | tuple) -> set[str]:
        if isinstance(m, tuple):
            return {c for c, _ in m[1]}
        if m.kind == "reference":
            return {m.value}
        if m.kind == "template":
            return set(re.findall(r"(?<!\\)\{([^{}]+)\}", m.value))
        if m.kind == "function":
            return set().union(*[self.references(a) for a in m.value[1].values()])
        return set()

    def needed(self, t: TriplesMap) -> list[str]:
        found = self.references(t.subject) | set().union(*[self.references(g) for g in t.graphs])
        for ps, os, gs in t.properties:
            found |= set().union(*[self.references(m) for m in [*ps, *os, *gs]])
        for other in self.maps.values():
            for _, os, _ in other.properties:
                for m in os:
                    if isinstance(m, tuple) and m[0] == t.name:
                        found |= {p for _, p in m[1]}
        return sorted(found)


# logical rows: (model_id, row, r0, r1, ...), each reference an array of strings


def _json_rows(contents: DataFrame, iterator: str | None, references: list[str]) -> DataFrame:
    path = iterator or "$"
    rows = contents.select("model_id", F.try_parse_json("content").alias("_v"), F.lit("").alias("_row"))
    pieces = re.split(r"\[\*\]", path)
    for i, piece in enumerate(pieces):
        here = piece if i == 0 else "$" + piece
        if here not in ("$", ""):
            rows = rows.withColumn("_v", F.try_variant_get("_v", here, "variant"))
        if i < len(pieces) - 1:
            array = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
            rows = rows.select("model_id", "_row", F.posexplode(array).alias("_n", "_v")).withColumn("_row", F.concat_ws(".", "_row", F.col("_n").cast("string")))
    rows = rows.where(F.col("_v").isNotNull())

    def reference(r: str) -> Column:
        p = r if r.startswith("$") else "$." + r if not r.startswith("[") else "$" + r
        if "[*]" in p:
            before, _, after = p.partition("[*]")
            items = F.try_variant_get("_v", before, "array<variant>")
            one = lambda v: F.try_variant_get(v, "$" + after, "string") if after else F.try_variant_get(v, "$", "string")
            return F.filter(F.transform(items, one), lambda x: x.isNotNull())
        many = F.try_variant_get("_v", p, "array<string>")
        single = F.try_variant_get("_v", p, "string")
        return F.coalesce(F.filter(many, lambda x: x.isNotNull()), F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))

    return rows.select("model_id", "_row", *[reference(r).alias(f"r{i}") for i, r in enumerate(references)])


def _xml_values(node: ET.Element, path: str) -> list[str]:
    path, _, attribute = path.partition("@")
    path = path.rstrip("/").removesuffix("/text()").removesuffix("text()") or "."
    found = node.findall(path.lstrip("/") if path.startswith("/") else path)
    if attribute:
        return [x.get(attribute) for x in found if x.get(attribute) is not None]
    return ["".join(x.itertext()) for x in found]


def _parsed_rows(contents: DataFrame, formulation: str, iterator: str | None, references: list[str]) -> DataFrame:
    """Rows of XML or CSV messages. XPath: the subset of the standard library's parser."""

    def values(content: str) -> Iterator[list[list[str]]]:
        if formulation == "CSV":
            for row in csv.DictReader(io.StringIO(content)):
                yield [[row[r]] if row.get(r) not in (None, "") else [] for r in references]
            return
        root = ET.fromstring(content)
        holder = ET.Element("_")
        holder.append(root)
        for node in holder.findall("." + (iterator if iterator.startswith("/") else "//" + iterator) if iterator else "*"):
            yield [_xml_values(node, r) for r in references]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, str(n), *v) for m, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, v in enumerate(values(c))]
            cols = list(zip(*rows, strict=True)) or [()] * (2 + len(references))
            types = [pa.string(), pa.string(), *[pa.list_(pa.string())] * len(references)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["model_id", "_row", *[f"r{i}" for i in range(len(references))]])

    ddl = ", ".join(["model_id string", "_row string", *[f"r{i} array<string>" for i in range(len(references))]])
    return contents.select("model_id", "content").transform(map_batches, run, ddl)


class Compiler:
    def __init__(self, mapping: Mapping, contents: DataFrame):
        self.mapping, self.contents = mapping, contents

    def rows(self, t: TriplesMap) -> tuple[DataFrame, dict[str, str]]:
        references = self.mapping.needed(t)
        make = _json_rows if t.formulation == "JSONPath" else None
        rows = make(self.contents, t.iterator, references) if make else _parsed_rows(self.contents, t.formulation, t.iterator, references)
        return rows, {r: f"r{i}" for i, r in enumerate(references)}

    def texts(self, m: TermMap, columns: dict[str, str]) -> Column:
        """The map's values in a row, as an array of strings."""
        if m.kind == "constant":
            return F.array(F.lit(m.value))
        if m.kind == "reference":
            return F.col(columns[m.value])
        if m.kind == "function":
            name, arguments = local_name(m.value[0]), {local_name(k): v for k, v in m.value[1].items()}
            if name not in FUNCTIONS:
                raise ValueError(f"unknown function {name}")
            parameters, f = FUNCTIONS[name]
            args = [F.get(self.texts(arguments[p], columns), F.lit(0)) if p in arguments else F.lit(None).cast("string") for p in parameters]
            missing = reduce(lambda a, b: a | b, [a.isNull() for a in args])
            return F.when(missing, F.array().cast("array<string>")).otherwise(F.array(F.when(~missing, f(*args))))
        out = F.array(F.lit(""))
        for piece in re.split(r"(?<!\\)(\{[^{}]+\})", m.value):
            if not piece:
                continue
            if piece[0] == "{":
                values = F.col(columns[piece[1:-1]])
                if m.term_type == "iri":
                    values = F.transform(values, lambda v: F.replace(F.replace(F.url_encode(v), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")))
                out = _crossed(out, values)
            else:
                text = piece.replace("\\{", "{").replace("\\}", "}")
                out = F.transform(out, _suffix(text))
        return out

    def terms(self, m: TermMap, columns: dict[str, str]) -> Column:
        texts = self.texts(m, columns)
        if m.term_type == "literal":
            dt = LANG_STRING if m.language else m.datatype or XSD_STRING
            return F.transform(texts, lambda v: literal(v, dt, m.language))
        return F.transform(texts, lambda v: term(v, m.term_type))

    def compile(self) -> DataFrame:
        parts, tables = [], {n: self.rows(t) for n, t in self.mapping.maps.items()}
        for t in self.mapping.maps.values():
            rows, columns = tables[t.name]
            subjects = self.terms(t.subject, columns)
            statements, joined = [], []
            for c in t.classes:
                statements.append(self.product(subjects, F.array(F.lit(RDF_TYPE)), F.array(term(F.lit(c), "iri")), t.graphs, columns))
            for predicates, objects, graphs in t.properties:
                for p in predicates:
                    for o in objects:
                        if isinstance(o, tuple):
                            joined.append((p, o, [*t.graphs, *graphs]))
                        else:
                            statements.append(self.product(subjects, self.texts(p, columns), self.terms(o, columns), [*t.graphs, *graphs], columns))
            if statements:
                flat = rows.select("model_id", F.explode(F.concat(*statements)).alias("t"))
                parts.append(from_terms(flat, F.col("t.s"), F.col("t.p"), F.col("t.o"), F.col("t.g")))
            for p, (parent, joins), graphs in joined:
                parts.append(self.reference(t, rows, columns, subjects, p, parent, joins, graphs, tables))
        return as_set(union(*parts))

    def product(self, s: Column, p: Column, o: Column, graphs: list[TermMap], columns: dict[str, str]) -> Column:
        g = F.concat(*[self.texts(x, columns) for x in graphs]) if graphs else F.array(F.lit(None).cast("string"))
        return F.flatten(F.transform(s, lambda a: F.flatten(F.transform(p, lambda b: F.flatten(F.transform(o, lambda c: F.transform(g, lambda d: F.struct(a.alias("s"), b.alias("p"), c.alias("o"), d.alias("g")))))))))

    def reference(self, t, rows, columns, subjects, p, parent, joins, graphs, tables) -> DataFrame:
        other, theirs = tables[parent]
        objects = self.terms(self.mapping.maps[parent].subject, theirs)
        g = F.concat(*[self.texts(x, columns) for x in graphs]) if graphs else F.array(F.lit(None).cast("string"))
        ps = self.texts(p, columns)
        heads = F.flatten(F.transform(subjects, lambda a: F.flatten(F.transform(ps, lambda b: F.transform(g, lambda d: F.struct(a.alias("s"), b.alias("p"), d.alias("g")))))))
        left = rows.select("model_id", "_row", heads.alias("heads"), *[F.col(columns[c]).alias(f"c{i}") for i, (c, _) in enumerate(joins)])
        right = other.select("model_id", *([] if joins else ["_row"]), objects.alias("tails"), *[F.col(theirs[q]).alias(f"q{i}") for i, (_, q) in enumerate(joins)])
        keys = ["model_id"] if joins else ["model_id", "_row"]
        for i in range(len(joins)):
            left, right = left.withColumn(f"k{i}", F.explode(f"c{i}")), right.withColumn(f"k{i}", F.explode(f"q{i}"))
            keys.append(f"k{i}")
        both = F.flatten(F.transform("heads", lambda h: F.transform("tails", lambda o: F.struct(h.alias("h"), o.alias("o")))))
        flat = left.join(right, keys).select("model_id", F.explode(both).alias("t"))
        return from_terms(flat, F.col("t.h.s"), F.col("t.h.p"), F.col("t.o"), F.col("t.h.g"))


def _crossed(out: Column, values: Column) -> Column:
    """Each text of ``out`` followed by each value."""
    return F.flatten(F.transform(out, lambda a: F.transform(values, lambda v: F.concat(a, v))))


def _suffix(text: str) -> Callable[[Column], Column]:
    return lambda a: F.concat(a, F.lit(text))


def apply_mapping(contents: DataFrame, mapping: str) -> DataFrame:
    """Quads of messages (model_id, content). If named graphs are made, each becomes a model of its own
    with the default graph's statements that are reachable from its objects."""
    read = Mapping(mapping)
    made = Compiler(read, contents).compile()
    if not any(p in (RR + "graph", RR + "graphMap") for node in read.g.values() for p in node):
        return made
    named = made.where(F.col("g").isNotNull())
    default = made.where(F.col("g").isNull())
    roots = named.where(F.col("o_kind") != "literal").select("model_id", F.struct("g", "o").alias("r"))
    below = subgraph(default, roots.select("model_id", F.col("r.o").alias("root")).distinct())
    owner = roots.select("model_id", F.col("r.g").alias("_g"), F.col("r.o").alias("root")).distinct()
    extra = below.join(owner, ["model_id", "root"]).withColumn("g", F.col("_g")).select(*COLUMNS)
    lone = default.join(named.select("model_id").distinct(), "model_id", "left_anti")
    return graphs_to_models(as_set(union(named, extra, lone)))
