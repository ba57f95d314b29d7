"""Models as text: N-Quads by expressions, Turtle and JSON-LD for whole models."""

from __future__ import annotations

import itertools
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.operators.quads import held, nquads_line
from tessera.vocabulary import RDF_TYPE, XSD, XSD_STRING

EXTENSIONS = {"application/n-quads": "nq", "application/n-triples": "nt", "text/turtle": "ttl", "application/ld+json": "jsonld", "application/json": "json"}


def nquads(quads: DataFrame) -> DataFrame:
    """(model_id, content): sorted N-Quads lines of each model."""
    if held(quads):
        lines = F.sort_array(F.array_distinct(F.transform("statements", lambda x: nquads_line(lambda c: x[c]))))
        return quads.where(F.size("statements") > 0).select("model_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    return quads.groupBy("model_id").agg(F.concat(F.array_join(F.array_sort(F.collect_set(nquads_line())), "\n"), F.lit("\n")).alias("content"))


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def prefixes_of(rows: list[tuple], known: Mapping[str, str]) -> dict[str, str]:
    """The prefixes whose namespace an IRI of the model uses."""
    used = [x for r in rows for x in ((r[0] if r[1] == "iri" else ""), r[2], (r[3] if r[4] == "iri" else ""), r[5] or "")]
    return {p: n for p, n in known.items() if any(u.startswith(n) for u in used)}


def turtle(rows: list[tuple], prefixes: Mapping[str, str] | None = None) -> str:
    """Turtle of rows (s, s_kind, p, o, o_kind, o_dt, o_lang); default graph only."""
    names = prefixes_of(rows, prefixes) if prefixes else {}

    def iri(v: str) -> str:
        for p, n in names.items():
            local = v[len(n) :]
            if v.startswith(n) and local and local.replace("_", "").isalnum():
                return f"{p}:{local}"
        return f"<{v}>"

    def node(v: str, k: str, dt: str | None = None, lang: str | None = None) -> str:
        if k != "literal":
            return iri(v) if k == "iri" else f"_:{v}"
        return _quote(v) + (f"@{lang}" if lang else f"^^{iri(dt)}" if dt and dt != XSD_STRING else "")

    subjects: dict = defaultdict(lambda: defaultdict(list))
    for s, sk, p, o, ok, dt, lang in _in_order(rows):
        subjects[node(s, sk)]["a" if p == RDF_TYPE else iri(p)].append(node(o, ok, dt, lang))
    head = "".join(f"@prefix {p}: <{n}> .\n" for p, n in names.items())
    blocks = [s + " " + " ;\n    ".join(f"{p} {', '.join(os)}" for p, os in sorted(ps.items())) + " .\n" for s, ps in subjects.items()]
    return head + ("\n" if head and blocks else "") + "\n".join(blocks)


_string = json.encoder.encode_basestring  # as dumps has it without ensure_ascii


def _in_order(rows: list[tuple]) -> list[tuple]:
    try:
        return sorted(rows)
    except TypeError:  # null meets text
        return sorted(rows, key=lambda r: tuple(x or "" for x in r))


def _flattened(nodes: Iterable[dict]) -> str:
    """``json.dumps(nodes, indent=2, ensure_ascii=False)`` for flattened nodes; with an indent, that is slow."""
    texts = []
    for n in nodes:
        parts = []
        for key, values in n.items():
            if key == "@id":
                parts.append(f'    "@id": {_string(values)}')
                continue
            items = [f"      {_string(v)}" if key == "@type" else "      {\n" + ",\n".join([f"        {_string(k)}: {_string(x)}" for k, x in v.items()]) + "\n      }" for v in values]
            parts.append(f"    {_string(key)}: [\n" + ",\n".join(items) + "\n    ]")
        texts.append("  {\n" + ",\n".join(parts) + "\n  }")
    return "[\n" + ",\n".join(texts) + "\n]" if texts else "[]"


def json_ld(rows: list[tuple], frame: Mapping | None = None) -> str:
    """Flattened JSON-LD, or one framed tree: nodes of the frame's @type with what they link to embedded."""
    nodes: dict[str, dict] = {}

    def name(v: str, k: str) -> str:
        return v if k == "iri" else f"_:{v}"

    for s, sk, p, o, ok, dt, lang in _in_order(rows):
        n = nodes.setdefault(name(s, sk), {"@id": name(s, sk)})
        if p == RDF_TYPE:
            n.setdefault("@type", []).append(name(o, ok))
        elif ok != "literal":
            n.setdefault(p, []).append({"@id": name(o, ok)})
        else:
            value: dict = {"@value": o}
            if lang:
                value["@language"] = lang
            elif dt and dt != XSD_STRING:
                value["@type"] = dt
            n.setdefault(p, []).append(value)
    if frame is None:
        return _flattened(nodes.values())
    context = frame.get("@context", {})
    short = {(v["@id"] if isinstance(v, dict) else v): k for k, v in context.items() if not k.startswith("@") and (isinstance(v, str) or "@id" in v)}
    wanted = frame.get("@type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    wanted = [context.get(w, w) if not isinstance(context.get(w), dict) else context[w]["@id"] for w in wanted] if wanted else None

    def compact(value: dict, seen: tuple) -> object:
        if "@value" in value:
            if set(value) == {"@value"}:
                return value["@value"]
            if value.get("@type") == XSD + "integer":
                return int(value["@value"])
            if value.get("@type") == XSD + "boolean":
                return value["@value"] == "true"
            return value
        target = value["@id"]
        return tree(nodes[target], seen) if target in nodes and target not in seen else {"@id": target}

    def tree(n: dict, seen: tuple) -> dict:
        seen, out = (*seen, n["@id"]), {}
        for key, values in n.items():
            if key == "@id":
                out["@id"] = values
            else:
                items = [short.get(v, v) for v in values] if key == "@type" else [compact(v, seen) for v in values]
                out[short.get(key, key)] = items[0] if len(items) == 1 else items
        return out

    roots = [n for n in nodes.values() if wanted is None or set(wanted) & set(n.get("@type", []))]
    trees = [tree(n, ()) for n in roots]
    body = trees[0] if len(trees) == 1 else {"@graph": trees}
    return json.dumps({"@context": context, **body}, indent=2, ensure_ascii=False)


def serialise(quads: DataFrame, mime_type: str = "text/turtle", prefixes: Mapping[str, str] | None = None, frame: Mapping | None = None) -> DataFrame:
    """(model_id, content) of each model. A model is gathered in one row: models are messages, of bounded size."""
    if mime_type in ("application/n-quads", "application/n-triples"):
        return nquads(quads)
    if mime_type not in EXTENSIONS:
        raise ValueError(f"no writer for {mime_type}")
    names = ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # whole columns: a dictionary for each statement would take longer than its text
            parts = batch.column(1).flatten()
            rows = list(zip(*[parts.field(n).to_pylist() for n in names], strict=True))
            ends = list(itertools.accumulate(batch.column(1).value_lengths().to_pylist(), initial=0))
            models = [list(dict.fromkeys(rows[a:b])) for a, b in itertools.pairwise(ends)]
            texts = [turtle(m, prefixes) if mime_type == "text/turtle" else json_ld(m, frame) for m in models]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["model_id", "content"])

    models = quads.where(F.size("statements") > 0).select("model_id", "statements") if held(quads) else quads.groupBy("model_id").agg(F.collect_set(F.struct(*names)).alias("rows"))
    return models.transform(map_batches, run, "model_id string, content string")
