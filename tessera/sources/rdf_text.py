"""RDF text to quads: N-Triples and N-Quads by expressions, Turtle, TriG and JSON-LD by parsers.

Blank node labels are prefixed by nothing: they are unique with their ``model_id`` only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.operators.quads import COLUMNS, SCHEMA, as_set, nquads_line
from tessera.plans.sparql_parser import Parser, SparqlError, unescape
from tessera.vocabulary import LANG_STRING, RDF, RDF_TYPE, XSD, XSD_STRING

LINES = ("application/n-quads", "application/n-triples", "text/x-nquads")
TURTLE = ("text/turtle", "application/x-turtle", "application/trig", "text/n3")
JSON_LD = ("application/ld+json", "application/json")

Triple = tuple[tuple, str, tuple]


# lines

# no group repeats: the JVM's matcher recurses once for each turn of one, so long literals would end it
_IRI, _BLANK = r"<([^<>\"{}|^`\\\x00-\x20]*+(?:\\u[0-9A-Fa-f]{4}[^<>]*+)?)>", r"_:([^\s<>\"]*[^\s<>\".])"
_LINE = rf'^\s*+(?:{_IRI}|{_BLANK})\s*+<([^<>]*+)>\s*+(?:{_IRI}|{_BLANK}|"([^"]*+)"(?:@([A-Za-z][A-Za-z0-9-]*+)|\^\^<([^<>]*+)>)?)\s*+(?:<([^<>]*+)>)?\s*+\.\s*+(?:#.*)?$'
_MARK = "\x01"


def _plain(text: Column) -> Column:
    """The line with the same meaning and without escaped backslashes and quotes, or the mark, in it.

    Each is written as its code, which N-Quads allows; so the next quote ends a literal.
    """
    text = F.replace(text, F.lit(_MARK), F.lit("\\u0001"))
    codes = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005C")), F.lit('\\"'), F.lit("\\u0022"))
    return F.when(F.contains(text, F.lit("\\")), codes).otherwise(text)


def _unescaped(v: Column) -> Column:
    """Escapes by way of a JSON string, whose escapes are a superset of the lines' short ones."""
    short = F.regexp_replace(F.replace(v, F.lit("\\'"), F.lit("'")), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    # what is left of the long form lies beyond the codes of JSON's form
    wide = F.transform(F.split(short, r"\\U"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.decode(F.unhex(F.substring(x, 1, 8)), "UTF-32"), F.substr(x, F.lit(9)))))
    as_json = F.when(F.contains(short, F.lit("\\U")), F.array_join(wide, "")).otherwise(short)
    parsed = F.from_json(F.concat(F.lit('{"v":"'), as_json, F.lit('"}')), "v string", {"allowUnquotedControlChars": "true"})["v"]
    return F.when(F.contains(v, F.lit("\\")), parsed).otherwise(v)


def _is_blank(text: Column) -> Column:
    return F.trim(text).rlike(r"^(#.*)?$")


def _parts(text: Column) -> Column:
    """The parts of a line: one pass of the expression gives all, set apart by a mark that the line no longer holds."""
    return F.split(F.regexp_replace(_plain(text), _LINE, _MARK + _MARK.join(f"${i}" for i in range(1, 10))), _MARK)


def _checked(parts: Column, text: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("not a statement: "), F.substring(text, 1, 200)))
    return F.when(F.size(parts) == 10, parts).otherwise(wrong.cast("array<string>"))


def _statement(parts: Column) -> dict[str, Column]:
    """The columns of a statement but its model, each said once: a term that is taken apart later would be made for each of its fields."""
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    lang, iri, blank = F.lower(part(7)), part(4).isNotNull(), part(5).isNotNull()
    datatype = F.when(lang.isNotNull(), LANG_STRING).otherwise(F.coalesce(part(8), F.lit(XSD_STRING)))
    return {
        "g": part(9),
        "s": F.when(part(1).isNotNull(), _unescaped(part(1))).otherwise(part(2)),
        "s_kind": F.when(part(1).isNotNull(), "iri").otherwise("bnode"),
        "p": part(3),
        "o": F.when(blank & ~iri, part(5)).otherwise(_unescaped(F.when(iri, part(4)).otherwise(F.get(parts, F.lit(6))))),
        "o_kind": F.when(iri, "iri").when(blank, "bnode").otherwise("literal"),
        "o_dt": F.when(~iri & ~blank, datatype),
        "o_lang": F.when(~iri & ~blank, lang),
    }


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quads of N-Triples or N-Quads lines with a ``model_id``; comments and blank lines give nothing, broken ones raise."""
    text = F.col(column)
    # exploding an array of one keeps filters above from repeating the work
    cut = lines.where(~_is_blank(text)).select("model_id", text.alias("_text"), F.explode(F.array(_parts(text))).alias("_p"))
    rows = cut.withColumn("_p", _checked(F.col("_p"), F.col("_text"))).select("model_id", *[c.alias(n) for n, c in _statement(F.col("_p")).items()])
    return rows.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())


def parse_line_contents(contents: DataFrame, whole_models: bool = False) -> DataFrame:
    """As ``parse_lines`` for whole documents in ``content``; with ``whole_models`` each is all of its model."""
    if not whole_models:
        return as_set(parse_lines(contents.select("model_id", F.explode(F.split("content", r"\r?\n")).alias("value"))))
    lines = F.split("content", r"\r?\n")
    cut = contents.select("model_id", "content", F.explode(F.array(F.array_distinct(lines))).alias("_l"))
    as_written = lambda x: F.get(F.transform(F.array(_checked(_parts(x), x)), lambda parts: nquads_line(_statement(parts).__getitem__)), F.lit(0))
    rewritten = F.transform(F.filter("_l", lambda x: ~_is_blank(x)), as_written)
    # without other escapes than the writer's, tabs and comments, lines of one statement differ by blanks, case and the datatype of strings at most
    plain = ~F.col("content").rlike(r'\\[^nrt"\\]|[\t\r\x0b\f]|\. *#')
    keys = F.transform("_l", lambda x: F.lower(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(f"^^<{XSD_STRING}>"), F.lit(""))))
    apart = plain & (F.size(F.array_distinct(keys)) == F.size("_l"))
    return parse_lines(cut.select("model_id", F.explode(F.when(apart, F.col("_l")).otherwise(F.array_distinct(rewritten))).alias("value")))


# Turtle and TriG


class TurtleParser(Parser):
    """Statements as (graph, subject, predicate, object)."""

    def __init__(self, text: str, base: str = ""):
        super().__init__(text)
        self.base = base

    def statements(self) -> Iterator[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "lang" and text in ("@prefix", "@base") or kind == "word" and text.upper() in ("PREFIX", "BASE"):
                self.next()
                if text.lower().endswith("base"):
                    self.base = self.expand(*self.next())
                else:
                    name = self.next()[1]
                    self.prefixes[name.rstrip(":")] = self.expand(*self.next())
                if kind == "lang":
                    self.need(".")
                continue
            graph = None
            if self.take_word("GRAPH") or self.peek(1) == ("punct", "{"):
                graph = self.term()
            if graph is not None or self.is_punct("{"):
                self.need("{")
                yield from ((graph, *t) for t in self.triples())
                self.need("}")
                self.take(".")
                continue
            before = self.at
            yield from ((None, *t) for t in self.triples())
            if self.at == before:
                raise SparqlError(f"unexpected {self.peek()[1]!r}")

    def expand(self, kind: str, text: str) -> str:
        if kind == "iri":
            value = super().expand(kind, "<>") if text == "<>" else super().expand(kind, text)
            return value or self.base
        return super().expand(kind, text)


def _row(s: tuple, p: str, o: tuple, g: str | None = None) -> tuple:
    """(g, s, s_kind, p, o, o_kind, o_dt, o_lang) of parser terms."""
    kinds = {"iri": "iri", "bnode": "bnode", "lit": "literal"}
    dt, lang = (o[2], o[3]) if o[0] == "lit" else (None, None)
    return (g, s[1], kinds[s[0]], p, o[1], kinds[o[0]], dt, lang)


_NAME = r'<([A-Za-z][A-Za-z0-9+.-]*:[^<>"{}|^`\\\s]*)>'
_SIMPLE = rf'\s*(?:{_NAME}|(a)(?=\s)|_:([\w.-]*\w)|("[^"\\\n]*)"(?:\^\^{_NAME}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?|([.;,]))'
_SIMPLE_ALL, _SIMPLE_ONE = re.compile("(?:" + re.sub(r"\((?!\?)", "(?:", _SIMPLE) + r")*\s*"), re.compile(_SIMPLE)


def _simple_turtle(text: str) -> list[tuple] | None:
    """Rows of Turtle with absolute IRIs, labels and short strings without escapes; None for any other."""
    if not _SIMPLE_ALL.fullmatch(text):
        return None
    rows, place = [], "s"
    for iri, a, label, value, dt, lang, mark in _SIMPLE_ONE.findall(text):
        if place == "o":
            if iri:
                rows.append((None, s, sk, p, iri, "iri", None, None))
            elif value:
                rows.append((None, s, sk, p, value[1:], "literal", LANG_STRING if lang else dt or XSD_STRING, lang.lower() or None))
            elif label:
                rows.append((None, s, sk, p, label, "bnode", None, None))
            else:
                return None
            place = ""
        elif place == "":
            if not mark:
                return None
            place = {".": "s", ";": "p", ",": "o"}[mark]
        elif place == "p":
            if not iri and not a:
                return None
            p, place = iri or RDF_TYPE, "o"
        elif iri or label:
            s, sk, place = iri or label, "iri" if iri else "bnode", "p"
        else:
            return None
    return rows if place == "s" else None


def parse_turtle(text: str, base: str = "") -> list[tuple]:
    if (simple := _simple_turtle(text)) is not None:
        return list(dict.fromkeys(simple))
    rows = []
    for g, s, p, o in TurtleParser(text, base).statements():
        if p[0] != "iri" or s[0] == "lit":
            raise SparqlError("not a statement")
        rows.append(_row(s, p[1], o, g[1] if g else None))
    return list(dict.fromkeys(rows))


# JSON-LD


class JsonLd:
    """JSON-LD to statements: contexts (inline, nested, or by name from ``remote``), coercion, containers,
    lists, sets, graphs, reverse properties and language maps."""

    def __init__(self, remote: Mapping[str, Any] | None = None, base: str = ""):
        self.remote, self.base, self.count, self.rows = remote if remote is not None else {}, base, 0, []

    def blank(self) -> tuple:
        self.count += 1
        return ("bnode", f"b{self.count}")

    def context(self, active: dict, local: Any, seen: tuple = ()) -> dict:
        if local is None:
            return {}
        if isinstance(local, list):
            for part in local:
                active = self.context(active, part, seen)
            return active
        if isinstance(local, str):
            if local in seen:
                return active
            if local not in self.remote:
                raise ValueError(f"context {local} is not registered")
            document = self.remote[local]
            document = json.loads(document) if isinstance(document, str) else document
            return self.context(active, document.get("@context", document), (*seen, local))
        out = dict(active)
        for key, value in local.items():
            if key.startswith("@"):
                out[key] = value
            else:
                out[key] = {"@id": value} if isinstance(value, str) or value is None else dict(value)
        return out

    def expand(self, name: str, ctx: dict, vocab: bool, depth: int = 0) -> str | None:
        if name.startswith("@") or depth > 20:
            return name
        if vocab and name in ctx:
            target = ctx[name].get("@id", name) if isinstance(ctx[name], dict) else name
            if target is None:
                return None
            if target != name:
                return self.expand(target, ctx, True, depth + 1)
        prefix, colon, local = name.partition(":")
        if colon:
            if prefix == "_" or local.startswith("//"):
                return name
            if isinstance(ctx.get(prefix), dict) and ctx[prefix].get("@id"):
                return self.expand(ctx[prefix]["@id"], ctx, True, depth + 1) + local
            return name
        if vocab:
            return ctx["@vocab"] + name if ctx.get("@vocab") is not None else None
        base = ctx.get("@base", self.base) or ""
        if not base or not name:
            return base + name
        return re.sub(r"[^/]*$", "", base) + name if not name.startswith(("#", "/")) else base.split("#")[0].rstrip("/" if name[0] == "/" else "") + name

    def node_term(self, identifier: str) -> tuple:
        return ("bnode", identifier[2:]) if identifier.startswith("_:") else ("iri", identifier)

    def emit(self, g, s: tuple, p: str, o: tuple) -> None:
        self.rows.append(_row(s, p, o, g))

    def scalar(self, value: Any, definition: dict, ctx: dict) -> tuple | None:
        kind = definition.get("@type")
        if kind in ("@id", "@vocab") and isinstance(value, str):
            found = self.expand(value, ctx, kind == "@vocab")
            return self.node_term(found) if found is not None else None
        dt = self.expand(kind, ctx, True) if kind and not kind.startswith("@") else None
        if isinstance(value, bool):
            return ("lit", "true" if value else "false", dt or XSD + "boolean", None)
        if isinstance(value, int):
            return ("lit", f"{float(value):.15E}" if dt == XSD + "double" else str(value), dt or XSD + "integer", None)
        if isinstance(value, float):
            if value.is_integer() and abs(value) < 1e21 and dt != XSD + "double":
                return ("lit", str(int(value)), dt or XSD + "integer", None)
            mantissa, _, exponent = f"{value:.15E}".partition("E")
            text = mantissa.rstrip("0") + ("0" if mantissa.rstrip("0").endswith(".") else "")
            return ("lit", f"{text}E{int(exponent)}", dt or XSD + "double", None)
        lang = definition.get("@language", ctx.get("@language")) if dt is None else None
        return ("lit", value, LANG_STRING if lang else dt or XSD_STRING, lang.lower() if lang else None)

    def value(self, g, value: Any, definition: dict, ctx: dict) -> tuple | None:
        if value is None:
            return None
        if not isinstance(value, dict):
            return self.scalar(value, definition, ctx)
        keys = {self.alias(k, ctx): k for k in value}
        if "@value" in keys:
            raw = value[keys["@value"]]
            if raw is None:
                return None
            lang = value[keys["@language"]] if "@language" in keys else None
            kind = value[keys["@type"]] if "@type" in keys else None
            if kind == "@json":
                return ("lit", json.dumps(raw, sort_keys=True, separators=(",", ":")), RDF + "JSON", None)
            return self.scalar(raw, {"@type": kind, "@language": lang}, {**ctx, "@language": None})
        if "@list" in keys:
            return self.list(g, value[keys["@list"]], definition, ctx)
        return self.node(g, value, ctx)

    def list(self, g, items: Any, definition: dict, ctx: dict) -> tuple:
        head: tuple = ("iri", RDF + "nil")
        plain = {k: v for k, v in definition.items() if k != "@container"}
        terms = [self.list(g, x, plain, ctx) if isinstance(x, list) else self.value(g, x, plain, ctx) for x in (items if isinstance(items, list) else [items])]
        for t in reversed([t for t in terms if t is not None]):
            b = self.blank()
            self.emit(g, b, RDF + "first", t)
            self.emit(g, b, RDF + "rest", head)
            head = b
        return head

    def alias(self, key: str, ctx: dict) -> str:
        if key.startswith("@"):
            return key
        target = ctx[key].get("@id") if isinstance(ctx.get(key), dict) else None
        return target if isinstance(target, str) and target.startswith("@") else key

    def node(self, g, obj: dict, ctx: dict) -> tuple:
        if "@context" in obj:
            ctx = self.context(ctx, obj["@context"])
        keys = {self.alias(k, ctx): k for k in obj}
        identifier = obj.get(keys.get("@id", "@id"))
        expanded = self.expand(identifier, ctx, False) if isinstance(identifier, str) else None
        s = self.node_term(expanded) if expanded is not None else self.blank()
        for alias, key in keys.items():
            content = obj[key]
            if alias == "@type":
                for kind in content if isinstance(content, list) else [content]:
                    if (iri := self.expand(kind, ctx, True)) is not None:
                        self.emit(g, s, RDF_TYPE, self.node_term(iri))
            elif alias == "@graph":
                inner = s[1] if len(keys) > 1 and set(keys) - {"@context", "@graph"} else g
                for item in content if isinstance(content, list) else [content]:
                    self.node(inner, item, ctx)
            elif alias == "@reverse":
                for name, values in content.items():
                    for item in values if isinstance(values, list) else [values]:
                        o = self.value(g, item, {"@type": "@id"}, ctx)
                        if o is not None:
                            self.emit(g, o, self.expand(name, ctx, True), s)
            elif alias == "@included":
                for item in content if isinstance(content, list) else [content]:
                    self.node(g, item, ctx)
            elif not alias.startswith("@"):
                self.property(g, s, key, content, ctx)
        return s

    def property(self, g, s: tuple, key: str, content: Any, ctx: dict) -> None:
        definition = ctx[key] if isinstance(ctx.get(key), dict) else {}
        reverse = definition.get("@reverse")
        p = self.expand(reverse, ctx, True) if reverse else self.expand(key, ctx, True)
        if p is None or ":" not in p or p.startswith("_:"):
            return
        scope = self.context(ctx, definition["@context"]) if "@context" in definition else ctx
        containers = definition.get("@container") or []
        containers = containers if isinstance(containers, list) else [containers]
        if "@list" in containers and not (isinstance(content, dict) and "@list" in content):
            self.emit(g, s, p, self.list(g, content, definition, scope))
            return
        if definition.get("@type") == "@json":
            self.emit(g, s, p, ("lit", json.dumps(content, sort_keys=True, separators=(",", ":")), RDF + "JSON", None))
            return
        if "@language" in containers and isinstance(content, dict):
            for lang, texts in content.items():
                for t in texts if isinstance(texts, list) else [texts]:
                    self.emit(g, s, p, ("lit", t, XSD_STRING if lang == "@none" else LANG_STRING, None if lang == "@none" else lang.lower()))
            return
        if "@index" in containers and isinstance(content, dict):
            content = [x for v in content.values() for x in (v if isinstance(v, list) else [v])]
        if isinstance(content, dict) and "@set" in content:
            content = content["@set"]
        for item in content if isinstance(content, list) else [content]:
            for one in item if isinstance(item, list) else [item]:
                o = self.value(g, one, definition, scope)
                if o is not None:
                    self.emit(g, *((o, p, s) if reverse else (s, p, o)))


def _flat_nodes(document: Any) -> list[tuple] | None:
    """Rows of flattened JSON-LD with absolute names and no context; None for any other."""
    rows = []

    def absolute(name: Any) -> bool:
        return isinstance(name, str) and ":" in name and name[0] != "@"

    for node in document if isinstance(document, list) else [document]:
        if not isinstance(node, dict) or not absolute(s := node.get("@id")):
            return None
        s, sk = (s[2:], "bnode") if s.startswith("_:") else (s, "iri")
        for key, values in node.items():
            if key == "@id":
                continue
            if not isinstance(values, list) or key != "@type" and (not absolute(key) or key.startswith("_:")):
                return None
            for v in values:
                if key == "@type":
                    name = v
                elif not isinstance(v, dict):
                    return None
                elif "@value" in v:
                    value, kind, lang = v["@value"], v.get("@type"), v.get("@language")
                    known = ("@type" in v) + ("@language" in v)
                    if not isinstance(value, str) or known > 1 or len(v) != 1 + known or "@type" in v and not absolute(kind) or "@language" in v and not (isinstance(lang, str) and lang):
                        return None
                    rows.append((None, s, sk, key, value, "literal", LANG_STRING if lang else kind or XSD_STRING, lang.lower() if lang else None))
                    continue
                else:
                    name = v.get("@id") if len(v) == 1 else None
                if not absolute(name):
                    return None
                rows.append((None, s, sk, RDF_TYPE if key == "@type" else key, *((name[2:], "bnode") if name.startswith("_:") else (name, "iri")), None, None))
    return rows


def parse_json_ld(text: str | Any, remote: Mapping[str, Any] | None = None, base: str = "", context: Any = None) -> list[tuple]:
    """Rows of a JSON-LD document; ``context`` is in force before the document's own."""
    document = json.loads(text) if isinstance(text, str) else text
    if context is None and (flat := _flat_nodes(document)) is not None:
        return list(dict.fromkeys(flat))
    parser = JsonLd(remote, base)
    start = parser.context({}, context) if context is not None else {}
    for item in document if isinstance(document, list) else [document]:
        parser.node(None, item, start)
    return list(dict.fromkeys(parser.rows))


def parse(text: str, mime_type: str, remote: Mapping[str, Any] | None = None, base: str = "") -> list[tuple]:
    kind = (mime_type or "").split(";")[0].strip().lower()
    if kind in JSON_LD:
        return parse_json_ld(text, remote, base)
    if kind in TURTLE or kind in LINES:
        return parse_turtle(text, base) if kind not in LINES else parse_nquads(text)
    raise ValueError(f"unsupported mime type {mime_type!r}")


_TERM = r'<([^<>"{}|^`\x00-\x20]*)>|_:([^\s<>"]*[^\s<>".])'
_STATEMENT = re.compile(
    rf'\s*(?:{_TERM})\s*<([^<>]*)>\s*(?:{_TERM}|"([^"\\]*(?:\\.[^"\\]*)*)"(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^<([^<>]*)>)?)\s*(?:<([^<>]*)>)?\s*\.\s*(?:#.*)?$',
    re.DOTALL,
)


def parse_nquads(text: str) -> list[tuple]:
    """Rows of N-Quads on one machine, for documents of bounded size."""
    rows = []
    for line in re.split(r"\r?\n", text):
        if not (m := _STATEMENT.match(line)):
            if line.strip() and not line.lstrip().startswith("#"):
                raise SparqlError(f"not a statement: {line[:200]}")
            continue
        s, sb, p, o, ob, value, lang, dt, g = m.groups()
        subject = (unescape(s), "iri") if s is not None else (sb, "bnode")
        if value is None:
            rows.append((g, *subject, p, *((unescape(o), "iri") if o is not None else (ob, "bnode")), None, None))
        else:
            rows.append((g, *subject, p, unescape(value), "literal", LANG_STRING if lang else dt or XSD_STRING, lang.lower() if lang else None))
    return list(dict.fromkeys(rows))


def adapt(contents: DataFrame, remote: Mapping[str, Any] | None = None, base: str = "", whole_models: bool = False) -> DataFrame:
    """Quads of documents: ``contents`` has model_id, content and mime_type. A document that can't be read raises.

    With ``whole_models`` no two documents have one ``model_id``, so repeats are removed document by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, *r) for m, c, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for r in parse(c, t, remote, base)]
            cols = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=list(COLUMNS))

    lines = F.trim(F.lower(F.substring_index("mime_type", ";", 1))).isin(*LINES)
    parsed = contents.where(~F.coalesce(lines, F.lit(False))).select("model_id", "content", "mime_type").transform(map_batches, run, SCHEMA)
    parsed = parsed.unionByName(parse_line_contents(contents.where(lines), whole_models).select(*COLUMNS))
    return parsed if whole_models else as_set(parsed)
