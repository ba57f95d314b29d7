"""SPARQL expressions as columns.

A value is a kind with a column: ``term`` (a term struct), or the unboxed kinds ``bool``, ``int``,
``num``, ``dec``, ``str`` and ``iri``. Unboxed values stay plain columns through a whole expression, and
become terms where a variable is bound. An error is a null, as SPARQL's errors are unbound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.quads import TERM, iri, literal, term
from tessera.plans.sparql_parser import SparqlError
from tessera.vocabulary import RDF, XSD

NUMERIC = tuple(XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong"))


@dataclass
class Value:
    kind: str
    col: Column

    def term(self) -> Column:
        c = self.col
        return {
            "term": lambda: c,
            "bool": lambda: literal(c.cast("string"), XSD + "boolean"),
            "int": lambda: literal(c.cast("string"), XSD + "integer"),
            "num": lambda: literal(c.cast("string"), XSD + "double"),
            "dec": lambda: literal(c.cast("string"), XSD + "decimal"),
            "str": lambda: literal(c),
            "iri": lambda: iri(c),
        }[self.kind]()

    def text(self) -> Column:
        return self.col["v"] if self.kind == "term" else self.col.cast("string")

    def number(self) -> Column:
        if self.kind in ("int", "num", "dec"):
            return self.col
        if self.kind == "term":
            return F.when(self.col["dt"].isin(*NUMERIC), self.col["v"].try_cast("double"))
        return F.lit(None).cast("double")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind in ("int", "num", "dec"):
            return self.col != 0
        if self.kind in ("str", "iri"):
            return F.length(self.col) > 0
        t = self.col
        return F.when(t["dt"] == XSD + "boolean", t["v"].isin("true", "1")).when(t["dt"].isin(*NUMERIC), t["v"].try_cast("double") != 0).when(t["dt"] == XSD + "string", F.length(t["v"]) > 0)


def constant(node: tuple) -> Column:
    if node[0] == "iri":
        return iri(F.lit(node[1]))
    if node[0] == "lit":
        return literal(F.lit(node[1]), node[2], node[3])
    raise SparqlError(f"not a constant: {node}")


def _boxed(node: tuple) -> Value:
    if node[0] == "iri":
        return Value("iri", F.lit(node[1]))
    if node[2] == XSD + "integer":
        return Value("int", F.lit(int(node[1])).cast("long"))
    if node[2] in (XSD + "decimal", XSD + "double"):
        return Value("num", F.lit(float(node[1])))
    if node[2] == XSD + "boolean":
        return Value("bool", F.lit(node[1] == "true"))
    if node[2] == XSD + "string":
        return Value("str", F.lit(node[1]))
    return Value("term", constant(node))


def compare(mark: str, a: Value, b: Value) -> Column:
    """Numbers by value, other values by text; terms are equal if they are the same or equal numbers."""
    numeric = {"int", "num", "dec"}
    ops = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y}
    if mark == "!=":
        return ~compare("=", a, b)
    op = ops[mark]
    if a.kind in numeric and b.kind in numeric:
        return op(a.col, b.col)
    if a.kind in numeric or b.kind in numeric:
        return op(a.number().cast("double"), b.number().cast("double"))
    if a.kind == "bool" or b.kind == "bool":
        return op(a.truth(), b.truth())
    if mark == "=":
        if a.kind == b.kind and a.kind in ("str", "iri"):
            return a.col == b.col
        x, y = a.term(), b.term()
        same_number = x["dt"].isin(*NUMERIC) & y["dt"].isin(*NUMERIC) & (x["v"].try_cast("double") == y["v"].try_cast("double"))
        return F.coalesce(same_number, F.lit(False)) | (x == y)
    if a.kind == "term" and b.kind == "term":
        both = a.col["dt"].isin(*NUMERIC) & b.col["dt"].isin(*NUMERIC)
        return F.when(both, op(a.col["v"].try_cast("double"), b.col["v"].try_cast("double"))).otherwise(op(a.text(), b.text()))
    return op(a.text(), b.text())


def _arithmetic(mark: str, a: Value, b: Value) -> Value:
    x, y = a.number(), b.number()
    if mark == "/":
        return Value("num", F.try_divide(x.cast("double"), y.cast("double")))
    out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[mark](x, y)
    return Value("int" if a.kind == b.kind == "int" else "num", out if a.kind == b.kind == "int" else out.cast("double"))


def _date_part(name: str) -> Callable:
    place = {"YEAR": r"^(-?\d{4,})-", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)", "HOURS": r"T(\d\d):", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)"}[name]
    return lambda a: Value("num" if name == "SECONDS" else "int", F.nullif(F.regexp_extract(a.text(), place, 1), F.lit("")).try_cast("double" if name == "SECONDS" else "long"))


def _regex(text: Value, pattern: Value, flags: Value | None = None) -> Value:
    p = pattern.text() if flags is None else F.concat(F.lit("(?"), flags.text(), F.lit(")"), pattern.text())
    return Value("bool", F.regexp_like(text.text(), p))


def _replace(text: Value, pattern: Value, by: Value, flags: Value | None = None) -> Value:
    p = pattern.text() if flags is None else F.concat(F.lit("(?"), flags.text(), F.lit(")"), pattern.text())
    return Value("str", F.regexp_replace(text.text(), p, by.text()))


def _substring(text: Value, start: Value, length: Value | None = None) -> Value:
    n = length.number().cast("int") if length else F.lit(2**31 - 1)
    return Value("str", F.substr(text.text(), start.number().cast("int"), n))


def _number_of_same_kind(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda a: Value("int" if a.kind == "int" else "num", f(a.number()).cast("long" if a.kind == "int" else "double"))


def _is_kind(k: str) -> Callable[[Value], Value]:
    return lambda a: Value("bool", a.term()["k"] == k)


def _string(f: Callable[..., Column], kind: str = "str") -> Callable[..., Value]:
    return lambda *a: Value(kind, f(*[x.text() for x in a]))


#: Functions by upper-case name or IRI; each takes values and gives a value.
FUNCTIONS: dict[str, Callable[..., Value]] = {
    "STR": _string(lambda a: a),
    "IRI": _string(lambda a: a, "iri"),
    "URI": _string(lambda a: a, "iri"),
    "CONCAT": _string(lambda *a: F.concat(*a)),
    "STRDT": lambda a, dt: Value("term", literal(a.text(), dt.text())),
    "STRLANG": lambda a, lang: Value("term", literal(a.text(), RDF + "langString", lang.text())),
    "LANG": lambda a: Value("str", F.when(a.term()["k"] == "literal", F.coalesce(a.term()["lang"], F.lit("")))),
    "LANGMATCHES": lambda a, b: Value("bool", F.when(b.text() == "*", a.text() != "").otherwise((F.lower(a.text()) == F.lower(b.text())) | F.startswith(F.lower(a.text()), F.concat(F.lower(b.text()), F.lit("-"))))),
    "DATATYPE": lambda a: Value("iri", a.term()["dt"]),
    "STRLEN": lambda a: Value("int", F.char_length(a.text()).cast("long")),
    "UCASE": _string(F.upper),
    "LCASE": _string(F.lower),
    "SUBSTR": _substring,
    "STRSTARTS": _string(F.startswith, "bool"),
    "STRENDS": _string(F.endswith, "bool"),
    "CONTAINS": _string(F.contains, "bool"),
    "STRBEFORE": lambda a, b: Value("str", F.when(F.contains(a.text(), b.text()), F.substr(a.text(), F.lit(1), F.position(b.text(), a.text()) - 1)).otherwise("")),
    "STRAFTER": lambda a, b: Value("str", F.when(F.contains(a.text(), b.text()), F.substr(a.text(), F.position(b.text(), a.text()) + F.char_length(b.text()))).otherwise("")),
    "ENCODE_FOR_URI": _string(lambda a: F.replace(F.url_encode(a), F.lit("+"), F.lit("%20"))),
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": _number_of_same_kind(F.abs),
    "ROUND": _number_of_same_kind(lambda c: F.floor(c + 0.5)),
    "CEIL": _number_of_same_kind(F.ceil),
    "FLOOR": _number_of_same_kind(F.floor),
    "MD5": _string(F.md5),
    "SHA1": _string(F.sha1),
    "SHA256": _string(lambda a: F.sha2(a, 256)),
    "SHA384": _string(lambda a: F.sha2(a, 384)),
    "SHA512": _string(lambda a: F.sha2(a, 512)),
    "ISIRI": _is_kind("iri"),
    "ISURI": _is_kind("iri"),
    "ISBLANK": _is_kind("bnode"),
    "ISLITERAL": _is_kind("literal"),
    "ISNUMERIC": lambda a: Value("bool", a.number().isNotNull()),
    "SAMETERM": lambda a, b: Value("bool", a.term() == b.term()),
    "NOW": lambda: Value("term", literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), XSD + "dateTime")),
    "TZ": lambda a: Value("str", F.regexp_extract(a.text(), r"(Z|[+-]\d\d:\d\d)$", 1)),
    XSD + "integer": lambda a: Value("int", a.text().try_cast("double").cast("long")),
    XSD + "double": lambda a: Value("num", a.text().try_cast("double")),
    XSD + "decimal": lambda a: Value("num", a.text().try_cast("double")),
    XSD + "float": lambda a: Value("num", a.text().try_cast("double")),
    XSD + "string": _string(lambda a: a),
    XSD + "boolean": lambda a: Value("bool", a.text().isin("true", "1")),
    XSD + "dateTime": lambda a: Value("term", literal(a.text(), XSD + "dateTime")),
    **{n: _date_part(n) for n in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS")},
}


def register(name: str, function: Callable[..., Value]) -> None:
    """Add a function under an IRI (or an upper-case name)."""
    FUNCTIONS[name] = function


def _common(values: list[Value]) -> tuple[str, list[Column]]:
    kinds = {v.kind for v in values}
    if len(kinds) == 1:
        return kinds.pop(), [v.col for v in values]
    return "term", [v.term() for v in values]


def evaluate(node: tuple, variables: Callable[[str], Column | None]) -> Value:
    """``variables`` gives the term column of a name, or None if nothing binds it."""
    sub = lambda n: evaluate(n, variables)
    tag = node[0]
    if tag == "var":
        col = variables(node[1])
        return Value("term", col if col is not None else F.lit(None).cast(TERM))
    if tag in ("iri", "lit"):
        return _boxed(node)
    if tag == "op":
        mark = node[1]
        if mark in ("and", "or"):
            a, b = sub(node[2]).truth(), sub(node[3]).truth()
            return Value("bool", a & b if mark == "and" else a | b)
        if mark == "not":
            return Value("bool", ~sub(node[2]).truth())
        if mark == "neg":
            a = sub(node[2])
            return Value("int" if a.kind == "int" else "num", -a.number())
        if mark in "+-*/":
            return _arithmetic(mark, sub(node[2]), sub(node[3]))
        return Value("bool", compare(mark, sub(node[2]), sub(node[3])))
    if tag == "in":
        left, found = sub(node[1]), F.lit(False)
        for item in node[2]:
            found = found | compare("=", left, sub(item))
        return Value("bool", ~found if node[3] else found)
    if tag == "call":
        name, args = node[1], node[2]
        if name == "BOUND":
            col = variables(args[0][1])
            return Value("bool", col.isNotNull() if col is not None else F.lit(False))
        values = [sub(a) for a in args]
        if name == "COALESCE":
            kind, cols = _common(values)
            return Value(kind, F.coalesce(*cols))
        if name == "IF":
            kind, cols = _common(values[1:])
            return Value(kind, F.when(values[0].truth(), cols[0]).when(~values[0].truth(), cols[1]))
        if name == "BNODE":
            return Value("term", term(F.sha2(F.concat_ws("|", *[v.text() for v in values]), 256), "bnode"))
        if name not in FUNCTIONS:
            raise SparqlError(f"unknown function {name}")
        return FUNCTIONS[name](*values)
    raise SparqlError(f"{tag} can't stand here")
