"""GeoJSON geometries in models to WKT literals."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.functions.geo import number
from tessera.operators.closure import subgraph
from tessera.operators.quads import COLUMNS, as_set, from_terms, iri, literal, term, union
from tessera.vocabulary import GEO, GEOJSON, LOCN, RDF, RDF_TYPE, SF

GEOMETRY = GEOJSON + "geometry"
COORDINATES = GEOJSON + "coordinates"
GEOMETRIES = GEOJSON + "geometries"
#: How deep the coordinate lists of each type are.
DEPTHS = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3, "GeometryCollection": 0}


def _items(graph: dict, head: str) -> list[tuple]:
    out = []
    while head != RDF + "nil":
        out += graph[head].get(RDF + "first", [])[:1]
        rest = graph[head].get(RDF + "rest", [])
        if not rest:
            break
        head = rest[0][0]
    return out


def _position(graph: dict, head: str) -> str:
    return " ".join(number(float(v)) for v, _ in _items(graph, head)[:2])


def _nested(graph: dict, head: str, depth: int, bracket: bool) -> str:
    """``depth`` levels of lists above positions; ``bracket`` puts positions in brackets, as in MULTIPOINT."""
    if depth == 0:
        return f"({_position(graph, head)})" if bracket else _position(graph, head)
    return "(" + ", ".join(_nested(graph, v, depth - 1, bracket) for v, _ in _items(graph, head)) + ")"


def geometry_wkt(rows: list[tuple[str, str, str, str]], root: str) -> tuple[str, str]:
    """(type name, WKT) of the geometry node ``root`` in rows of (s, p, o, o_kind)."""
    graph: dict = defaultdict(lambda: defaultdict(list))
    for s, p, o, k in rows:
        graph[s][p].append((o, k))

    def build(node: str) -> tuple[str, str]:
        types = [o for o, _ in graph[node][RDF_TYPE]]
        if len(types) != 1:
            raise ValueError("Could not determine rdf:type of the geometry")
        name = types[0].removeprefix(GEOJSON)
        if name not in DEPTHS or not types[0].startswith(GEOJSON):
            raise ValueError(f"Geotype {types[0]} not supported")
        if name == "GeometryCollection":
            parts = []
            for o, _ in graph[node][GEOMETRIES]:
                heads = [v for v, _ in _items(graph, o)] if RDF + "first" in graph[o] else [o]
                parts += [build(h)[1] for h in heads]
            return name, f"GEOMETRYCOLLECTION ({', '.join(sorted(parts))})"
        head = graph[node][COORDINATES][0][0]
        body = f"({_position(graph, head)})" if name == "Point" else _nested(graph, head, DEPTHS[name], name == "MultiPoint")
        return name, f"{name.upper()} {body}"

    return build(root)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [geometry_wkt([tuple(r[c] for c in ("s", "p", "o", "o_kind")) for r in rows], root) for root, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["model_id", "root", "type", "wkt"])


def geojson_to_wkt(quads: DataFrame, as_node: bool = False) -> DataFrame:
    """Replace each geojson:geometry and the nodes below it by a WKT literal on locn:geometry.

    With ``as_node`` the object is a blank node of the geometry's sf: type with geo:asWKT instead.
    """
    holders = quads.where((F.col("p") == GEOMETRY) & (F.col("o_kind") != "literal"))
    below = subgraph(quads, holders.select("model_id", F.col("o").alias("root")).distinct())
    grouped = below.groupBy("model_id", "root").agg(F.collect_set(F.struct("s", "p", "o", "o_kind")).alias("rows"))
    wkt = grouped.transform(map_batches, _convert, "model_id string, root string, type string, wkt string")
    rest = quads.join(below.select("model_id", "s", "p", "o").distinct(), ["model_id", "s", "p", "o"], "left_anti").where(F.col("p") != GEOMETRY)
    held = holders.join(wkt.withColumnRenamed("root", "o"), ["model_id", "o"])
    owner, text = term(F.col("s"), F.col("s_kind")), literal(F.col("wkt"), GEO + "wktLiteral")
    if not as_node:
        return as_set(union(rest.select(*COLUMNS), from_terms(held, owner, F.lit(LOCN + "geometry"), text)))
    node = term(F.concat(F.lit("wkt"), F.sha2(F.concat_ws("|", "s", "o"), 256)), "bnode")
    return as_set(
        union(
            rest.select(*COLUMNS),
            from_terms(held, owner, F.lit(LOCN + "geometry"), node),
            from_terms(held, node, F.lit(RDF_TYPE), iri(F.concat(F.lit(SF), F.col("type")))),
            from_terms(held, node, F.lit(GEO + "asWKT"), text),
        )
    )
