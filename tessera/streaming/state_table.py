"""State of a stream's members in tables beside its checkpoint, for filters within micro-batches.

A stream's models are parsed and transformed in each micro-batch, as batches; what the filters of
members have to remember is kept here: one small Parquet table for each micro-batch, with the last
value of each key it has seen. A micro-batch that is run again after a failure writes its table
again, and reads only those of the batches before it. Every ``MERGE`` tables are merged into one.

The filters are those of ``tessera.operators.versions``: what is remembered joins the micro-batch
as arrivals before all others, and is left out of what passes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import versions

MERGE = 16
_NAME = re.compile(r"^(delta|whole)-(\d{12})$")


class StateTable:
    """Last values by key; ``value`` is a column of strings, whose order is that of its meaning where that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def tables(self, batch: int) -> list[tuple[str, int]]:
        """(kind, batch) of the finished tables that together hold what batches before ``batch`` left."""
        found = [(m[1], int(m[2])) for n in storage.list_dir(self.spark, self.path) if (m := _NAME.match(n)) and int(m[2]) < batch]
        found = [x for x in found if storage.exists(self.spark, f"{self._name(*x)}/_SUCCESS")]
        merged = max((b for kind, b in found if kind == "whole"), default=-1)
        return [("whole", merged)] * (merged >= 0) + [x for x in found if x[0] == "delta" and x[1] > merged]

    def _name(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}-{batch:012d}"

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max_by("value", "batch").alias("value"), F.max("batch").alias("batch"))

    def before(self, batch: int, keys: DataFrame) -> DataFrame:
        """(key, value) as the batches before ``batch`` left it, for the given keys only."""
        schema = "key string, value string, batch long"
        there = self.tables(batch)
        if not there:
            return self.spark.createDataFrame([], "key string, value string")
        rows = self.spark.read.schema(schema).parquet(*[self._name(*x) for x in there])
        return self._latest(rows.join(keys.select("key").distinct(), "key", "left_semi")).select("key", "value")

    def put(self, batch: int, rows: DataFrame) -> None:
        """Keep (key, value) of a batch; then merge, if enough tables have come together."""
        rows.select(F.col("key").cast("string"), F.col("value").cast("string"), F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(self._name("delta", batch))
        there = self.tables(batch)
        if len(there) > MERGE:
            old = [self._name(*x) for x in there]
            self._latest(self.spark.read.parquet(*old)).write.mode("overwrite").parquet(self._name("whole", there[-1][1]))
            for path in old:
                if path != self._name("whole", there[-1][1]):
                    storage.delete(self.spark, path)


def _with_known(members: DataFrame, state: StateTable, batch: int, key: str, value: str, arrival: str) -> DataFrame:
    """``members`` and, as arrivals before them, what is known of their keys; ``_at`` orders arrivals."""
    known = state.before(batch, members.select(F.col(key).cast("string").alias("key")))
    old = known.select(F.col("key").alias(key), F.col("value").alias(value), F.lit(0).alias("_round"))
    both = members.withColumn("_round", F.lit(1)).unionByName(old, allowMissingColumns=True)
    return both.withColumn("_at", F.struct("_round", arrival))


def _passed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Those of this batch, written down before the state moves on."""
    return storage.stash(rows.where("_round = 1").select(*like.columns), "passed")


def changed(members: DataFrame, state: StateTable, batch: int, key: str = "member_id", digest: str = "hash", arrival: str = "model_id") -> DataFrame:
    """Members whose digest isn't that of the arrival before, in this batch or an earlier one."""
    passed = _passed(versions.changed(_with_known(members, state, batch, key, digest, arrival), key, digest, "_at"), members)
    state.put(batch, members.groupBy(F.col(key).alias("key")).agg(F.max_by(digest, arrival).alias("value")))
    return passed


def exactly_once(members: DataFrame, state: StateTable, batch: int, key: str = "member_id", arrival: str = "model_id") -> DataFrame:
    """The first arrival of each member, in this batch or an earlier one."""
    marked = members.withColumn("_seen", F.lit("1"))
    passed = _passed(versions.exactly_once(_with_known(marked, state, batch, key, "_seen", arrival), key, "_at"), members)
    state.put(batch, members.select(F.col(key).alias("key"), F.lit("1").alias("value")).distinct())
    return passed


def latest_state(members: DataFrame, state: StateTable, batch: int, key: str = "version_of", timestamp: str = "ts", arrival: str = "model_id") -> DataFrame:
    """Members newer than all arrivals of their entity before; ``timestamp`` is a column of times."""
    text = F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    dated = members.withColumn("_ts", text)
    passed = _passed(versions.latest_state(_with_known(dated, state, batch, key, "_ts", arrival), key, "_ts", "_at"), members)
    known = state.before(batch, members.select(F.col(key).cast("string").alias("key")))
    fresh = members.where(F.col(timestamp).isNotNull()).select(F.col(key).cast("string").alias("key"), text.alias("value"))
    state.put(batch, fresh.unionByName(known).groupBy("key").agg(F.max("value").alias("value")))
    return passed
