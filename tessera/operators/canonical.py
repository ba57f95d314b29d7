"""Canonical N-Quads of models, their digests, and change detection on whole members.

Models without blank nodes are hashed by expressions: the sorted lines, joined. Models with blank
nodes are canonicalised by hashing each node's surroundings, and by trying the orders of nodes
that look alike, after the RDF dataset canonicalisation algorithm.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.operators.quads import nquads_line
from tessera.sources.rdf_text import parse_nquads
from tessera.vocabulary import XSD_STRING

#: Orders of nodes that look alike that are tried for one model.
MAX_ORDERS = 50_000


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def _text(v: str, k: str, dt: str | None, lang: str | None, names) -> str:
    if k == "iri":
        return f"<{v}>"
    if k == "bnode":
        return names(v)
    end = f"@{lang}" if lang else f"^^<{dt}>" if dt and dt != XSD_STRING else ""
    return f'"{_escape(v)}"{end}'


def line(row: tuple, names) -> str:
    """One N-Quads line of (g, s, s_kind, p, o, o_kind, o_dt, o_lang)."""
    g, s, sk, p, o, ok, dt, lang = row
    graph = f" <{g}>" if g else ""
    return f"{_text(s, sk, None, None, names)} <{p}> {_text(o, ok, dt, lang, names)}{graph} ."


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(rows: list[tuple]) -> str:
    """Canonical N-Quads of a model's rows: equal for isomorphic models."""
    rows = sorted(set(rows), key=str)
    near: dict[str, list[tuple]] = defaultdict(list)
    for r in rows:
        for v, k in ((r[1], r[2]), (r[4], r[5])):
            if k == "bnode" and (not near[v] or near[v][-1] is not r):
                near[v].append(r)
    colours = {b: "" for b in near}

    def refine(colours: dict[str, str]) -> dict[str, str]:
        """Digests of surroundings, until no more nodes are told apart."""
        for _ in range(len(near) + 1):
            new = {b: _digest(colours[b] + "".join(sorted(line(r, lambda v, b=b: "_:self" if v == b else f"_:{colours[v]}") for r in near[b]))) for b in near}
            if len(set(new.values())) == len(set(colours.values())):
                return new
            colours = new
        return colours

    tried = itertools.count()

    def best(colours: dict[str, str]) -> str:
        groups: dict[str, list[str]] = defaultdict(list)
        for b, c in colours.items():
            groups[c].append(b)
        alike = sorted((c for c, members in groups.items() if len(members) > 1))
        if not alike:
            order = {b: f"_:c14n{i}" for i, b in enumerate(sorted(colours, key=colours.__getitem__))}
            return "\n".join(sorted(line(r, order.__getitem__) for r in rows)) + ("\n" if rows else "")
        if next(tried) > MAX_ORDERS:
            raise ValueError("the model has too many blank nodes that look alike")
        return min(best(refine({**colours, b: _digest(colours[b] + "!")})) for b in groups[alike[0]])

    return best(refine(colours))


def _canonical_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [canonical(parse_nquads("\n".join(lines))) for lines in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(t) for t in texts], pa.string()), *batch.columns[2:]], names=["model_id", "hash", "first", "last"])


def _hashed(quads: DataFrame) -> DataFrame:
    """(model_id, hash, first, last): the digest of each model, and the first and last of its named subjects.

    A model's lines are gathered in one row: models are messages, of bounded size.
    """
    blank = F.bool_or((F.col("s_kind") == "bnode") | (F.col("o_kind") == "bnode"))
    named = F.when(F.col("s_kind") == "iri", F.col("s"))
    grouped = quads.groupBy("model_id").agg(F.array_sort(F.collect_set(nquads_line())).alias("lines"), blank.alias("blank"), F.min(named).alias("first"), F.max(named).alias("last"))
    plain = grouped.where("NOT blank").select("model_id", F.sha2(F.concat(F.array_join("lines", "\n"), F.lit("\n")), 256).alias("hash"), "first", "last")
    odd = grouped.where("blank").select("model_id", "lines", "first", "last")
    return plain.unionByName(map_batches(odd, _canonical_models, "model_id string, hash string, first string, last string"))


def model_hashes(quads: DataFrame) -> DataFrame:
    """(model_id, hash): SHA-256 of each model's canonical N-Quads."""
    return _hashed(quads).select("model_id", "hash")


def member_hashes(quads: DataFrame) -> DataFrame:
    """(model_id, member_id, hash); a model must have exactly one named subject, others raise."""
    wrong = F.raise_error(F.concat(F.lit("a member needs one named subject, found "), F.coalesce(F.concat_ws(" and ", "first", "last"), F.lit("none"))))
    one = F.coalesce(F.col("first") == F.col("last"), F.lit(False))
    return _hashed(quads).select("model_id", F.when(one, F.col("first")).otherwise(wrong.cast("string")).alias("member_id"), "hash")


def route_changed(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The models of ``after`` that differ from those of ``before``, and those that are isomorphic to them:
    the routes of a transformer that found something to do, and of one that didn't."""
    old, new = model_hashes(before), model_hashes(after)
    same = new.join(old, ["model_id", "hash"], "left_semi").select("model_id")
    return after.join(same, "model_id", "left_anti").select(*after.columns), after.join(same, "model_id", "left_semi").select(*after.columns)
