"""A repository of statements as Parquet, in which a batch of models replaces what was said of its subjects.

The store is cut into buckets by subject. A version writes the buckets that a batch touches and a
manifest that names, for every bucket, the version that holds it; a version counts from the moment
its manifest is there. Models wait in a table of their own until enough have come or time is up,
so the store isn't rewritten for each of them; what waits is kept if writing fails.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators.quads import COLUMNS, SCHEMA
from tessera.sinks import stores

BUCKETS = 64
_MANIFEST = "manifest.json"


def _bucket(subject: str = "s"):
    return F.pmod(F.xxhash64(subject), F.lit(BUCKETS)).cast("int")


class Repository:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock

    def _versions(self) -> list[str]:
        return [n for n in storage.list_dir(self.spark, self.path) if n.startswith("v") and storage.exists(self.spark, f"{self.path}/{n}/{_MANIFEST}")]

    def manifest(self) -> dict[str, str]:
        """The version that holds each bucket."""
        there = self._versions()
        return json.loads(storage.read_text(self.spark, f"{self.path}/{there[-1]}/{_MANIFEST}")) if there else {}

    def read(self) -> DataFrame:
        held = self.manifest()
        if not held:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{v}/bucket={b}" for b, v in sorted(held.items())])

    def commit(self, batch: DataFrame, graph: str | None = None) -> str:
        """Put a batch into the store; gives the name of the new version."""
        held, store = self.manifest(), self.read()
        dead = storage.stash(stores.replaced(store, batch), "replaced")
        fresh = batch.withColumn("g", F.lit(graph).cast("string")) if graph else batch
        touched = {r[0] for r in dead.select("s").unionByName(fresh.select("s")).select(_bucket()).distinct().collect()}  # at most BUCKETS
        old = [f"{self.path}/{held[str(b)]}/bucket={b}" for b in sorted(touched) if str(b) in held]
        rest = self.spark.read.schema(SCHEMA).parquet(*old).join(dead, "s", "left_anti") if old else store.limit(0)
        rows = rest.select(*COLUMNS).unionByName(fresh.select(*COLUMNS)).withColumn("bucket", _bucket())
        numbers = [int(n[1:]) for n in storage.list_dir(self.spark, self.path) if n.startswith("v")]
        name = f"v{max(numbers, default=-1) + 1:08d}"
        rows.repartition("bucket").dropDuplicates().write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        filled = {n.removeprefix("bucket=") for n in storage.list_dir(self.spark, f"{self.path}/{name}") if n.startswith("bucket=")}
        now = {b: v for b, v in held.items() if int(b) not in touched} | {b: name for b in filled}
        storage.write_text(self.spark, f"{self.path}/{name}/{_MANIFEST}", json.dumps(now))
        return name

    # models that wait

    def _waiting(self) -> list[str]:
        found = storage.list_dir(self.spark, f"{self.path}/waiting")
        return [f"{self.path}/waiting/{n}" for n in found if storage.exists(self.spark, f"{self.path}/waiting/{n}/_SUCCESS")]

    def add(self, batch: DataFrame, number: int, size: int = 500, timeout: float = 120.0, graph: str | None = None) -> str | None:
        """Let a micro-batch wait; commit all that waits once ``size`` models have come or the first has waited
        for ``timeout`` seconds. A micro-batch that is run again takes its own place."""
        batch.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/waiting/{number:012d}")
        there = self._waiting()
        since = min(storage.modified(self.spark, f"{p}/_SUCCESS") for p in there)
        models = self.spark.read.schema(SCHEMA).parquet(*there).agg(F.count_distinct("model_id")).first()[0]
        return self.flush(graph) if models >= size or self.clock() - since >= timeout else None

    def flush(self, graph: str | None = None) -> str | None:
        """Commit all that waits."""
        there = self._waiting()
        if not there:
            return None
        name = self.commit(self.spark.read.schema(SCHEMA).parquet(*there), graph)
        for p in there:
            storage.delete(self.spark, p)
        return name
