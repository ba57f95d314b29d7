"""Reachability inside models: sub-graphs reachable from roots, and transitive closures.

A semi-naive loop: each round joins only the newly reached nodes with the edges, and drops those
reached before, so cycles end. Tables of a round are written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quads import COLUMNS
from tessera.storage import stash

MAX_ROUNDS = 1000


def reach(edges: DataFrame, starts: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(model_id, start, node, depth): every node reachable over ``edges`` (model_id, src, dst), starts included at depth 0.

    ``starts`` has (model_id, start). Depth is the least number of steps.
    """
    edges = stash(edges.select("model_id", "src", "dst").distinct(), "edges")
    seen = stash(starts.select("model_id", "start").distinct().withColumn("node", F.col("start")).withColumn("depth", F.lit(0)), "reach")
    fresh = seen
    for depth in range(1, max_rounds + 1):
        step = fresh.join(edges.withColumnRenamed("src", "node"), ["model_id", "node"]).select("model_id", "start", F.col("dst").alias("node")).distinct()
        fresh = stash(step.join(seen, ["model_id", "start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    raise RuntimeError(f"reachability did not settle in {max_rounds} rounds")


def subgraph(quads: DataFrame, roots: DataFrame, follow: Column | None = None) -> DataFrame:
    """Quads with an extra column ``root``: all statements reachable from each root through object nodes.

    ``roots`` has (model_id, root). ``follow`` restricts the statements whose objects are entered,
    for example to blank nodes.
    """
    into = quads.where(F.col("o_kind") != "literal")
    if follow is not None:
        into = into.where(follow)
    edges = into.select("model_id", F.col("s").alias("src"), F.col("o").alias("dst"))
    nodes = reach(edges, roots.select("model_id", F.col("root").alias("start")))
    return quads.join(nodes.select("model_id", F.col("node").alias("s"), F.col("start").alias("root")), ["model_id", "s"]).select(*COLUMNS, "root")
