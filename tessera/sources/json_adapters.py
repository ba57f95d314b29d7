"""JSON messages to quads: JSON with a given JSON-LD context, and NGSI v2 entities."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.functions.mapping import NGSI_NAMES, NGSI_SCHEMES, ngsi_date, ngsi_id, ngsi_name
from tessera.operators.quads import COLUMNS, SCHEMA, as_set, from_terms, iri, literal
from tessera.sources.rdf_text import parse_json_ld
from tessera.vocabulary import XSD, XSD_STRING

JSON = "application/json"


def _numbered(contents: DataFrame, documents) -> DataFrame:
    """Run ``documents(content, mime_type) -> lists of rows``; message n of several gets ``#n`` on its model_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m, c, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                models = documents(c, t)
                rows += [(m if len(models) == 1 else f"{m}#{n}", *r) for n, model in enumerate(models) for r in model]
            cols = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=list(COLUMNS))

    return as_set(contents.select("model_id", "content", "mime_type").transform(map_batches, run, SCHEMA))


def _check_mime(mime_type: str | None) -> None:
    if (mime_type or "").split(";")[0].strip().lower() != JSON:
        raise ValueError(f"unsupported mime type {mime_type!r}: {JSON} is needed")


def json_to_ld(contents: DataFrame, context: Any, remote: Mapping[str, Any] | None = None, force: bool = False) -> DataFrame:
    """Quads of JSON objects read with ``context``, which replaces any they bring.

    An object is one model, an array one model for each element, which must be objects. The mime
    type must be application/json unless ``force``.
    """

    def documents(content: str, mime_type: str) -> list[list[tuple]]:
        if not force:
            _check_mime(mime_type)
        data = json.loads(content)
        items = data if isinstance(data, list) else [data]
        if not all(isinstance(x, dict) for x in items):
            raise ValueError("only JSON objects can be read as models")
        return [parse_json_ld({**x, "@context": context}, remote) for x in items]

    return _numbered(contents, documents)


def _date(text: str) -> str:
    return text if text.endswith("Z") else text + "Z"


def _name(key: str) -> str:
    return NGSI_NAMES.get(key, key)


def ngsi_identifier(identifier: str, kind: str) -> str:
    return identifier if identifier.split(":")[0].lower() in NGSI_SCHEMES and ":" in identifier else f"urn:ngsi-ld:{kind}:{identifier}"


def _wrapped(kind: str | None, value: Any) -> Any:
    """Dates and postal addresses become typed values."""
    if value is None or kind is None:
        return value
    if kind.lower() in ("timestamp", "datetime"):
        return {"@type": "DateTime", "@value": _date(str(value))}
    if kind.lower() == "postaladdress":
        return {"@type": "PostalAddress", "@value": value}
    return value


def _attribute(raw: Any, observed: str | None) -> dict:
    """An NGSI v2 attribute as an NGSI-LD one."""
    if not isinstance(raw, dict):
        raw = {"value": raw}
    kind, value = raw.get("type"), raw.get("value")
    out: dict[str, Any] = {"type": "Property"}
    if kind in ("Reference", "Relationship"):
        if not isinstance(value, str):
            raise ValueError(f"a reference must be a string, not {value!r}")
        out |= {"type": "Relationship", "object": value}
    else:
        out["type"] = "GeoProperty" if kind in ("geo:json", "GeoProperty") else "Property"
        if (v := _wrapped(kind, value)) is not None:
            out["value"] = v
    seen = _date(raw["dateObserved"]) if raw.get("dateObserved") else None
    metadata = dict(raw.get("metadata") or {})
    for name, target in (("timestamp", "observedAt"), ("unitCode", "unitCode")):
        if name in metadata:
            held = metadata.pop(name)
            found = held.get("value") if isinstance(held, dict) else held
            if target == "observedAt":
                seen = _date(str(found))
            else:
                out[target] = found
    out |= {_name(k): _attribute(v, None) for k, v in metadata.items()}
    if out["type"] != "Relationship":
        seen = observed if observed is not None else seen
    if seen is not None:
        out["observedAt"] = seen
    out |= {_name(k): _attribute(v, None) for k, v in raw.items() if k not in ("type", "value", "metadata", "dateObserved")}
    return out


def ngsi_to_ld(entity: Mapping[str, Any], contexts: list[str]) -> dict:
    """An NGSI v2 entity as an NGSI-LD document. The entity's dateObserved is pushed onto its properties."""

    def plain(x: Any) -> str | None:
        found = x.get("value") if isinstance(x, dict) else x
        return _date(str(found)) if found is not None else None

    observed = plain(entity.get("dateObserved"))
    out: dict[str, Any] = {"@context": contexts, "id": ngsi_identifier(str(entity["id"]), str(entity.get("type"))), "type": entity.get("type")}
    for key in ("dateCreated", "dateModified"):
        if plain(entity.get(key)) is not None:
            out[_name(key)] = plain(entity[key])
    if observed is not None:
        out["dateObserved"] = _attribute({"type": "timestamp", "value": observed}, observed)
    for key, raw in entity.items():
        if key not in ("id", "type", "dateCreated", "dateModified", "dateObserved"):
            out[_name(key)] = _attribute(raw, observed)
    return out


def ngsi_v2_to_ld(contents: DataFrame, data_identifier: str, core_context: str, ld_context: str | None = None, remote: Mapping[str, Any] | None = None) -> DataFrame:
    """Quads of the entities under the key ``data_identifier`` of each message: one model each."""
    contexts = [c for c in (core_context, ld_context) if c]

    def documents(content: str, mime_type: str) -> list[list[tuple]]:
        _check_mime(mime_type)
        data = json.loads(content).get(data_identifier)
        items = data if isinstance(data, list) else [data]
        return [parse_json_ld(ngsi_to_ld(x, contexts), remote) for x in items if x is not None]

    return _numbered(contents, documents)


def ngsi_attributes(entities: DataFrame, model_id: Column, identifier: Column, kind: Column, attributes: Column, prefix: str) -> DataFrame:
    """The flat fast path: quads of a map column of attribute structs (type, value), without leaving the JVM.

    Each attribute becomes a blank node with its kind and its value, or the object of a relationship.
    """
    rows = entities.select(model_id.cast("string").alias("model_id"), ngsi_id(identifier, kind).alias("id"), F.explode(attributes).alias("k", "a"))
    node = F.struct(F.sha2(F.concat_ws("|", "id", "k"), 256).alias("v"), F.lit("bnode").alias("k"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    type_ = ngsi_name(F.coalesce("a.type", F.lit("Property")))
    fixed = F.when(type_.isin("Relationship", "GeoProperty"), type_).otherwise("Property")
    dated = F.lower(F.col("a.type")).isin("datetime", "timestamp")
    value = F.when(dated, literal(ngsi_date(F.col("a.value")), XSD + "dateTime")).otherwise(literal(F.col("a.value"), XSD_STRING))
    owner = from_terms(rows, iri(F.col("id")), F.concat(F.lit(prefix), ngsi_name(F.col("k"))), node)
    kinds = from_terms(rows, node, F.lit(prefix + "type"), literal(fixed))
    values = from_terms(rows.where(fixed != "Relationship"), node, F.lit(prefix + "value"), value)
    objects = from_terms(rows.where(fixed == "Relationship"), node, F.lit(prefix + "object"), iri(F.col("a.value")))
    return owner.unionByName(kinds).unionByName(values).unionByName(objects)
