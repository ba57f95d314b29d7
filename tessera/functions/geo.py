"""WKT functions: vertices by expression, geodesics by vectorised numpy.

Coordinates are longitude and latitude in degrees on WGS 84. A leading ``<crs>`` is kept.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.quads import literal
from tessera.plans.sparql_expressions import Value, register
from tessera.vocabulary import GEO

NAMESPACE = "https://opengis.net/def/function/geosparql/custom#"
# The WGS 84 ellipsoid.
MAJOR, MINOR, FLATTENING = 6378137.0, 6356752.314245, 1 / 298.257223563
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = re.compile(rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*")
_CRS = re.compile(r"^\s*(<[^>]*>)\s*")


def geodesic(lon1, lat1, lon2, lat2, tolerance: float = 1e-12, rounds: int = 200) -> np.ndarray:
    """Metres between points by the inverse method on the ellipsoid; 0 for coincident points.

    Nearly antipodal points, for which the iteration doesn't settle, keep the last estimate.
    """
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, dtype=float)) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(x)) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    difference = lon2 - lon1
    lam = difference.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / ss)
            ca2 = 1 - sa**2
            mid = np.where(ca2 == 0, 0.0, cs - 2 * s1 * s2 / ca2)
            c = FLATTENING / 16 * ca2 * (4 + FLATTENING * (4 - 3 * ca2))
            last, lam = lam, difference + (1 - c) * FLATTENING * sa * (sigma + c * ss * (mid + c * cs * (2 * mid**2 - 1)))
            if np.all(np.abs(lam - last) <= tolerance):
                break
        square = ca2 * (MAJOR**2 - MINOR**2) / MINOR**2
        a = 1 + square / 16384 * (4096 + square * (-768 + square * (320 - 175 * square)))
        b = square / 1024 * (256 + square * (-128 + square * (74 - 47 * square)))
        turn = b * ss * (mid + b / 4 * (cs * (2 * mid**2 - 1) - b / 6 * mid * (4 * ss**2 - 3) * (4 * mid**2 - 3)))
    return np.where(ss == 0, 0.0, MINOR * a * (sigma - turn))


def vertices(wkt: str | None) -> np.ndarray:
    """All (x, y) of a WKT geometry, in order."""
    text = _CRS.sub("", wkt or "")
    return np.array([(float(x), float(y)) for x, y in _PAIR.findall(text)], dtype=float).reshape(-1, 2)


def number(x: float) -> str:
    """Shortest decimal form, without a final .0."""
    text = np.format_float_positional(x, trim="-")
    return "0" if text in ("-0", "") else text


def point(wkt: str, xy) -> str:
    crs = _CRS.match(wkt)
    return (crs[1] + " " if crs else "") + f"POINT({number(xy[0])} {number(xy[1])})"


def segment_lengths(xy: np.ndarray) -> np.ndarray:
    return geodesic(xy[:-1, 0], xy[:-1, 1], xy[1:, 0], xy[1:, 1]) if len(xy) > 1 else np.zeros(0)


def line_length(wkt: str | None) -> float | None:
    xy = vertices(wkt)
    return float(segment_lengths(xy).sum()) if len(xy) else None


def point_at(wkt: str | None, offset: float | None) -> str | None:
    """The point ``offset`` metres from the start, linear in degrees inside its segment; null outside the line."""
    xy = vertices(wkt)
    if offset is None or offset != offset or len(xy) < 2:
        return None
    lengths = segment_lengths(xy)
    ends = np.cumsum(lengths)
    at = int(np.searchsorted(ends, offset, side="right"))
    if offset < 0 or at >= len(lengths):
        return None
    share = (offset - (ends[at] - lengths[at])) / lengths[at]
    return point(wkt, (1 - share) * xy[at] + share * xy[at + 1])


def mid_point(wkt: str | None) -> str | None:
    total = line_length(wkt)
    return point_at(wkt, total / 2) if total else None


def distance_from_start(wkt: str | None, where: str | None) -> float | None:
    """Length along the line to the given point, whose segment is the one whose infinite planar line is nearest."""
    xy, target = vertices(wkt), vertices(where)
    if len(xy) < 2 or not len(target):
        return None
    p = target[0]
    if len(xy) == 2:
        return float(geodesic(xy[0, 0], xy[0, 1], p[0], p[1]))
    step = xy[1:] - xy[:-1]
    norm = np.hypot(step[:, 0], step[:, 1])
    cross = np.abs(step[:, 0] * (p[1] - xy[:-1, 1]) - step[:, 1] * (p[0] - xy[:-1, 0]))
    gap = np.where(norm > 0, cross / np.where(norm > 0, norm, 1), np.hypot(*(p - xy[:-1]).T))
    route = np.vstack([xy[: int(gap.argmin()) + 1], p])
    return float(segment_lengths(route).sum())


@F.pandas_udf(T.DoubleType())
def line_length_udf(wkt: pd.Series) -> pd.Series:
    parts = [vertices(w) for w in wkt]
    flat = np.vstack([*parts, np.zeros((0, 2))])
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    out = np.zeros(len(parts))
    if len(flat) > 1:  # all segments of the batch at once
        inside = owner[1:] == owner[:-1]
        np.add.at(out, owner[1:][inside], segment_lengths(flat)[inside])
    return pd.Series(out).where([len(x) > 0 for x in parts])


@F.pandas_udf(T.StringType())
def mid_point_udf(wkt: pd.Series) -> pd.Series:
    return pd.Series([mid_point(w) for w in wkt])


@F.pandas_udf(T.StringType())
def point_at_udf(wkt: pd.Series, offset: pd.Series) -> pd.Series:
    return pd.Series([point_at(w, o) for w, o in zip(wkt, offset, strict=True)])


@F.pandas_udf(T.DoubleType())
def distance_from_start_udf(wkt: pd.Series, where: pd.Series) -> pd.Series:
    return pd.Series([distance_from_start(w, p) for w, p in zip(wkt, where, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def geodesic_udf(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(geodesic(lon1, lat1, lon2, lat2))


def _crs(wkt: Column) -> Column:
    found = F.regexp_extract(wkt, r"^\s*(<[^>]*>)", 1)
    return F.when(found != "", F.concat(found, F.lit(" "))).otherwise("")


def _point(wkt: Column, pair: Column) -> Column:
    xy = F.split(F.trim(pair), r"\s+")
    return F.when(F.trim(pair) != "", F.concat(_crs(wkt), F.lit("POINT("), xy[0], F.lit(" "), F.get(xy, F.lit(1)), F.lit(")")))


def first_coordinate(wkt: Column) -> Column:
    """The first vertex as a POINT, as it is written."""
    return _point(wkt, F.regexp_extract(wkt, rf"\(+\s*({_NUMBER}\s+{_NUMBER})", 1))


def last_coordinate(wkt: Column) -> Column:
    """The last vertex as a POINT, as it is written."""
    return _point(wkt, F.regexp_extract(wkt, rf"(?s).*[,(]\s*({_NUMBER}\s+{_NUMBER})[^,(]*$", 1))


def line_at_index(wkt: Column, index: Column) -> Column:
    """The n-th line, from 0, of a MULTILINESTRING; null if there is none."""
    lines = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    line = F.when(index >= 0, F.get(lines, index.cast("int")))
    return F.when(line.isNotNull(), F.concat(_crs(wkt), F.lit("LINESTRING("), line, F.lit(")")))


def _wkt(c: Column) -> Value:
    return Value("term", literal(c, GEO + "wktLiteral"))


register(NAMESPACE + "firstCoordinate", lambda a: _wkt(first_coordinate(a.text())))
register(NAMESPACE + "lastCoordinate", lambda a: _wkt(last_coordinate(a.text())))
register(NAMESPACE + "lineLength", lambda a: Value("num", line_length_udf(a.text())))
register(NAMESPACE + "midPoint", lambda a: _wkt(mid_point_udf(a.text())))
register(NAMESPACE + "pointAtFromStart", lambda a, d: _wkt(point_at_udf(a.text(), d.text().try_cast("double"))))
register(NAMESPACE + "distanceFromStart", lambda a, p: Value("num", distance_from_start_udf(a.text(), p.text())))
register(NAMESPACE + "lineAtIndex", lambda a, i: _wkt(line_at_index(a.text(), i.text().try_cast("int"))))
