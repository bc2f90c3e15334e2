"""Nested supports: random prefixes of one order, or patches that grow from the middle of each component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import proportions, share_label, shuffled
from gridloom.graph import search
from gridloom.graph.components import components
from gridloom.operators import weights
from gridloom.runtime import cut
from gridloom.sources.cells import Grid


#: Rows and columns of the tiles whose components are found in one task each.
TILE = 128


def local_labels(support: DataFrame, grid: Grid, contiguity: str = "queen", tile: int = TILE) -> DataFrame:
    """(cell, row, col, tr, tc, local): components within tiles, by their smallest cell. A tile is one task's work."""
    moves = [m for m in weights.steps(contiguity) if m > (0, 0)]

    def label(group: pa.Table) -> pa.Table:
        group = group.sort_by("cell")
        cell, row, col = (group.column(c).to_numpy() for c in ("cell", "row", "col"))
        n = len(cell)
        place = np.full((tile + 2, tile + 2), -1)
        r, c = row - row.min() // tile * tile + 1 if n else row, col - col.min() // tile * tile + 1 if n else col
        place[r, c] = np.arange(n)
        a, b = [], []
        for dr, dc in moves:
            other = place[r + dr, c + dc]
            a.append(np.flatnonzero(other >= 0))
            b.append(other[other >= 0])
        a, b, root = np.concatenate(a), np.concatenate(b), np.arange(n)
        while True:  # roots hook onto smaller ones, then everything points to its root
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        return group.append_column("local", pa.array(cell[root], pa.int64()))

    cells = support.select(F.col("cell").cast("bigint").alias("cell"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))
    tiles = cells.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    return tiles.groupBy("tr", "tc").applyInArrow(label, "cell long, row long, col long, tr long, tc long, local long")


def labelled(support: DataFrame, grid: Grid, contiguity: str = "queen", tile: int = TILE) -> DataFrame:
    """(component, cell, row, col): components numbered from 1 by their smallest cell; isolated cells are components.

    Components are found within tiles first; only those that touch over tile borders are then joined to components of
    components, and only labels, never cells, meet by the component they belong to, however large it is.
    """
    local = cut(local_labels(support, grid, contiguity, tile), "local")
    at = lambda c: F.col(c) % tile
    border = local.where(at("row").isin(0, tile - 1) | at("col").isin(0, tile - 1))
    end = lambda e: border.select(F.col("cell").alias(e), *[F.col(c).alias(c + e) for c in ("tr", "tc", "local")])
    over = weights.edges(border, grid, contiguity).join(end("i"), "i").join(end("j"), "j").where("tri <> trj OR tci <> tcj")
    found = components(over.select("locali", "localj").distinct(), "locali", "localj")
    labels = local.select("local").distinct()
    root = cut(labels.join(found, labels["local"] == found["node"], "left").select("local", F.coalesce("component", "local").alias("root")), "roots")
    numbers = numbered(root.select("root").distinct(), "root", "component")
    return local.join(root.join(numbers, "root").select("local", "component"), "local").select("component", "cell", "row", "col")


def numbered(df: DataFrame, by: str, into: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of a distinct column: within ranges of it, plus what ranges before hold."""
    parts = max(1, min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = cut(df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")] if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.withColumn(into, (base + rank).cast("bigint")).drop("_part")


def allocate(sizes: DataFrame, k: int, total: int) -> DataFrame:
    """(component, n, take): k cells over components by largest remainder: the floor of each quota, then one more by
    falling fraction, components in order among equals; nobody gets more than it has.

    Components are bounded groups of one row each; the ranking goes over fractions in ranges, not in one task.
    """
    quota = F.col("n") * F.lit(float(k)) / F.lit(float(total))
    part = sizes.select("component", "n", F.floor(quota).cast("bigint").alias("base"), (quota - F.floor(quota)).alias("fraction"))
    left = k - (part.agg(F.sum("base").alias("b")).first()["b"] or 0)
    key = part.withColumn("key", F.struct((-F.round("fraction", 12)).alias("f"), "component"))
    ranked = numbered(key.select("key"), "key", "rank")
    out = key.join(ranked, "key").select("component", "n", F.least("n", F.col("base") + F.when(F.col("rank") <= left, 1).otherwise(0)).alias("take"))
    return out


def random_supports(support: DataFrame, shares: list[float], seed: int = 42) -> DataFrame:
    """(scenario, cell): the first max(1, floor(share * V)) cells of one shuffled order, so supports are nested."""
    shares = proportions(shares)
    order = numbered(support.select("cell", F.struct(shuffled(F.col("cell"), seed).alias("h"), "cell").alias("key")), "key", "place")
    v = order.count()
    return _prefixes(order, [(share_label(s), max(1, int(s * v + 1e-9))) for s in shares])


def _prefixes(order: DataFrame, takes: list[tuple[str, int]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("k")) for n, k in takes])).alias("t")
    return order.select("cell", "place", each).where(F.col("place") <= F.col("t.k")).select("t.scenario", "cell")


def seeds(parts: DataFrame) -> DataFrame:
    """(component, cell): of each component the cell nearest to its mean row and column, the smallest of equals."""
    middle = parts.groupBy("component").agg(F.avg("row").alias("r"), F.avg("col").alias("c"))
    d = F.round(F.pow(F.col("row") - F.col("r"), F.lit(2)) + F.pow(F.col("col") - F.col("c"), F.lit(2)), 9)
    return parts.join(middle, "component").groupBy("component").agg(F.min(F.struct(d.alias("d"), "cell")).alias("best")).select("component", "best.cell")


def spatial_supports(support: DataFrame, grid: Grid, shares: list[float], contiguity: str = "queen", bound: int = 250_000) -> DataFrame:
    """(scenario, cell): of each component the cells first reached from its middle, as many as it is allocated."""
    shares = proportions(shares)
    parts = cut(labelled(support, grid, contiguity), "labelled")
    sizes = cut(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    ranked = weights.edges(support, grid, contiguity, ranked=True).join(parts.select("component", F.col("cell").alias("i")), "i").select("component", "i", "o", "j")
    order = cut(search.orders(cut(ranked, "ranked"), cut(seeds(parts), "seeds"), sizes, bound, grid), "orders")
    total = parts.count()
    out = None
    for s in shares:
        k = max(1, int(s * total + 1e-9))
        one = order.join(allocate(sizes, k, total), "component").where(F.col("place") <= F.col("take")).select(F.lit(share_label(s)).alias("scenario"), "cell")
        out = one if out is None else out.unionByName(one)
    return out


def scenario_sizes(scenarios: DataFrame, full: int) -> DataFrame:
    return scenarios.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_cells")).withColumn("pct_of_full_common_support", F.round(F.col("n_cells") * 100.0 / F.lit(float(full)), 4))


def prepare(support: DataFrame, grid: Grid, shares: list[float], mode: str = "random", contiguity: str = "queen", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The scenarios of a mode and their table of sizes; an empty support is an error."""
    n = support.count()
    if not n:
        raise ValueError("the support has no cell")
    if mode not in ("random", "spatial"):
        raise ValueError(f"mode is random or spatial, not {mode}")
    found = random_supports(support, shares, seed) if mode == "random" else spatial_supports(support, grid, shares, contiguity)
    return found, scenario_sizes(found, n)
