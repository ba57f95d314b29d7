"""Connected components of a graph held as an edge table.

Each round hooks every vertex to the neighbour of lowest random rank, follows those hooks once
more, and renames the edges' ends. Loops and repeated edges vanish, so the edge table shrinks
by a constant factor on average, whatever the order of ids along a chain. All tables stay
distributed; each round's tables are written, so joins on a hub read plain exchanges, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import stash


def _hooks(edges: DataFrame, salt: int) -> DataFrame:
    """(v, p): each vertex and the lowest-ranked vertex among itself and its neighbours."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    both = edges.select(F.explode(ends).alias("e")).select("e.v", "e.w")
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("r"), F.col(c).alias("p"))
    return both.groupBy("v").agg(F.min(rank("w")).alias("m")).select("v", F.least(F.col("m"), rank("v"))["p"].alias("p"))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of ``edges``: vertices share a root if and only if linked.

    Null ends and loops are ignored. The root is an arbitrary member of the component. An empty
    edge table gives an empty result.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = stash(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    roots = None
    for salt in range(max_rounds):
        if edges.isEmpty():
            break
        hooks = stash(_hooks(edges, salt), "hooks")
        up = hooks.select(F.col("v").alias("p"), F.col("p").alias("q"))
        jumps = stash(hooks.join(up, "p").select("v", F.col("q").alias("p")), "jumps")
        to = lambda end: jumps.select(F.col("v").alias(end), F.col("p").alias(f"{end}2"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = stash(moved.where("a != b").distinct(), "edges")
        if roots is None:
            roots = jumps.select("v", F.col("p").alias("root"))
        else:
            known = roots.join(jumps.select(F.col("v").alias("root"), "p"), "root", "left")
            roots = stash(known.select("v", F.coalesce("p", "root").alias("root")), "roots")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if roots is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots
