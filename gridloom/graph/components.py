"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut, release

#: Nodes with over a share of 1 / HOT of all edge ends, of which there are HOT at most, meet their edges by broadcast.
HOT = 1_000


def _signature(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _met(edge: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """Each edge with the ``m`` of its ``u``: those of frequent nodes by broadcast, the others by a shuffle."""
    often = F.col("n") * HOT > ends
    hot = F.broadcast(least.where(often).select("u", "m"))
    return edge.join(hot, "u").unionByName(edge.join(hot.select("u"), "u", "left_anti").join(least.where(~often).select("u", "m"), "u"))


def components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; ``component`` is the smallest node reachable.

    Self-loops, repeated edges and edges with a null end are ignored (a node with only such edges isn't
    returned). Nodes may be of any orderable type. Each round is two aggregates and joins on the node,
    the aggregates partial before they are shuffled, the joins without a hot key (``_met``), and is written to the
    shared folder, so lineage stays short. An empty table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    edge = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = _signature(edge)
    rounds = 0
    while seen[0]:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _met(both, least, 2 * seen[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _signature(new)
        release(edge)
        edge = new
        if now == seen:
            break
        seen = now
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = edge.select(F.col("v").alias("node")).distinct()
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
