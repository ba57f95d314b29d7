"""Functions for mappings and adapters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.vocabulary import CRS84

# Names that NGSI-LD has for keys and types of NGSI v2.
NGSI_NAMES = {"dateCreated": "createdAt", "dateModified": "modifiedAt", "timestamp": "observedAt", "geo:json": "GeoProperty", "Reference": "Relationship"}
NGSI_SCHEMES = ("urn", "http", "https")


def replace(content: Column, target: Column, replacement: Column) -> Column:
    """Every literal occurrence replaced."""
    return F.replace(content, target, replacement)


def epoch_to_iso8601(seconds: Column) -> Column:
    """Epoch seconds as a UTC instant with three fraction digits."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds.cast("long")), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_wkt(coordinates: Column, kind: Column) -> Column:
    """WKT with CRS84 from white-space separated numbers, decimal commas allowed.

    Kinds: POINT (exactly two numbers), LINESTRING, MULTIPOINT, POLYGON (pairs). Anything else raises.
    """
    parts = F.split(F.replace(coordinates, F.lit(","), F.lit(".")), r"\s+")
    odd = F.filter(parts, lambda x, i: i % 2 == 0)
    even = F.filter(parts, lambda x, i: i % 2 == 1)
    pairs = F.array_join(F.zip_with(odd, even, lambda x, y: F.concat(x, F.lit(" "), y)), ",")
    n = F.size(parts)
    wrong = lambda message: F.raise_error(F.concat(F.lit(message), n.cast("string"), F.lit(" elements"))).cast("string")
    body = (
        F.when((kind == "POINT") & (n != 2), wrong("Expected 2 coordinates. Got "))
        .when(kind.isin("LINESTRING", "MULTIPOINT", "POLYGON") & (n % 2 != 0), wrong("Expected pairs coordinates. Got "))
        .when(kind.isin("POINT", "LINESTRING", "MULTIPOINT"), F.concat(kind, F.lit("("), pairs, F.lit(")")))
        .when(kind == "POLYGON", F.concat(kind, F.lit("(("), pairs, F.lit("))")))
        .otherwise(F.raise_error(F.concat(F.lit("Not a valid/supported WKT type: "), kind)).cast("string"))
    )
    return F.concat(F.lit(f"<{CRS84}>"), body)


def ngsi_id(identifier: Column, kind: Column) -> Column:
    """An identifier whose scheme isn't urn, http or https becomes urn:ngsi-ld:type:id."""
    scheme = F.lower(F.regexp_extract(identifier, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin(*NGSI_SCHEMES), identifier).otherwise(F.concat(F.lit("urn:ngsi-ld:"), kind, F.lit(":"), identifier))


def ngsi_name(key: Column) -> Column:
    """A key or type under its NGSI-LD name."""
    out = F.when(F.lit(False), key)
    for old, new in NGSI_NAMES.items():
        out = out.when(key == old, new)
    return out.otherwise(key)


def ngsi_date(date: Column) -> Column:
    """A date that ends in Z."""
    return F.when(~date.endswith("Z"), F.concat(date, F.lit("Z"))).otherwise(date)
