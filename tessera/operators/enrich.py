"""Enrichment of models by HTTP, or by a lookup table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.arrow import map_batches
from tessera.operators.quads import COLUMNS, SCHEMA, as_set, union
from tessera.plans.sparql import property_path
from tessera.sources.http import Request, executor_from
from tessera.sources.rdf_text import parse


def requests_of(quads: DataFrame, url_path: str, body_path: str | None = None, header_path: str | None = None, method_path: str | None = None) -> DataFrame:
    """(model_id, url, body, headers, method) by property paths; GET by default, other methods than GET and POST raise."""
    found = property_path(quads, url_path).groupBy("model_id").agg(F.min("object.v").alias("url"))
    for name, path in (("body", body_path), ("headers", header_path), ("method", method_path)):
        if path is None:
            found = found.withColumn(name, F.lit(None).cast("array<string>" if name == "headers" else "string"))
            continue
        gathered = F.array_sort(F.collect_set("object.v")) if name == "headers" else F.min("object.v")
        found = found.join(property_path(quads, path).groupBy("model_id").agg(gathered.alias(name)), "model_id", "left")
    method = F.upper(F.coalesce("method", F.lit("GET")))
    return found.withColumn("method", F.when(method.isin("GET", "POST"), method).otherwise(F.raise_error(F.concat(F.lit("unsupported method "), method)).cast("string")))


def fetcher(options: Mapping[str, str]) -> Callable[[str, str, str | None, list[str]], tuple[int, str, str]]:
    """A fetch by HTTP with the options of the HTTP executor; headers are given as ``name: value``."""
    chosen = dict(options)

    def fetch(method: str, url: str, body: str | None, headers: list[str]) -> tuple[int, str, str]:
        pairs = {k.strip(): v.strip() for k, colon, v in (h.partition(":") for h in headers) if colon}
        got = executor_from(chosen)(Request(url, method, pairs, body.encode() if body is not None else None))
        return got.status, got.header("Content-Type") or chosen.get("adapter.config.mime-type", "application/n-quads"), got.body.decode()

    return fetch


def http_enrich(quads: DataFrame, fetch: Callable[[str, str, str | None, list[str]], tuple[int, str, str]], url_path: str, one_task: bool = False, **paths: str | None) -> DataFrame:
    """Unite each model with what its URL returns.

    ``fetch(method, url, body, headers)`` gives (status, mime type, content). Each different request
    is made once, by ``one_task`` where a rate limit has to hold for all. Failures and statuses other than 2xx leave a model as it is.
    """
    wanted = requests_of(quads, url_path, **paths)
    keys = ["method", "url", "body", "headers"]
    key = F.sha2(F.to_json(F.struct(*keys)), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, method, url, body, headers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                try:
                    status, mime, content = fetch(method, url, body, headers or [])
                    rows += [(k, *r) for r in parse(content, mime)] if 200 <= status < 300 else []
                except (OSError, ValueError):
                    continue
            cols = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=list(COLUMNS))

    asked = wanted.select(key.alias("k"), *keys).dropDuplicates(["k"])
    answers = (asked.coalesce(1) if one_task else asked).transform(map_batches, run, SCHEMA).withColumnRenamed("model_id", "k")
    added = wanted.select("model_id", key.alias("k")).join(answers, "k").drop("k")
    return as_set(union(quads, added))


def table_enrich(quads: DataFrame, reference: DataFrame, path: str) -> DataFrame:
    """Unite each model with the statements that ``reference`` quads have about the nodes at the path's end."""
    nodes = property_path(quads, path).where("object.k <> 'literal'").select("model_id", F.col("object.v").alias("s")).distinct()
    return as_set(union(quads, nodes.join(reference.drop("model_id"), "s").select(*COLUMNS)))
