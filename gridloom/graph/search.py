"""Breadth-first orders: within bounded groups, by windows of a lattice, or level by level over the cluster."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import col_of, row_of
from gridloom.operators import weights
from gridloom.runtime import cut
from gridloom.sources.cells import Grid


class Pieces:
    """Rows that are only added to: written tables, merged by eights, so that a row is written again as often as the
    logarithm of the number of additions, and what is read stays a union of few tables."""

    MERGED = 8

    def __init__(self, first: DataFrame):
        self.tiers: list[list[DataFrame]] = [[first]]

    def add(self, rows: DataFrame) -> None:
        """rows: written by ``cut``."""
        tier = 0
        while True:
            if tier == len(self.tiers):
                self.tiers.append([])
            self.tiers[tier].append(rows)
            if len(self.tiers[tier]) < self.MERGED:
                return
            old, self.tiers[tier] = self.tiers[tier], []
            rows = cut(_union(old), "merged")
            tier += 1

    def all(self) -> DataFrame:
        return _union([x for tier in self.tiers for x in tier])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def levels(edge: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(cell, level) of what the start cells reach in at most ``most`` steps; a job a level, of which only the new cells
    are written. Nothing is gathered: the frontier meets the edges by an equi-join."""
    front = cut(starts.select("cell", F.lit(0).cast("bigint").alias("level")).distinct(), "levels")
    seen, n = Pieces(front), 0
    pairs = edge.select(F.col("i").alias("cell"), F.col("j").alias("next")).distinct()
    while most is None or n < most:
        n += 1
        new = pairs.join(front.select("cell"), "cell", "left_semi").select(F.col("next").alias("cell")).distinct().join(seen.all().select("cell"), "cell", "left_anti")
        front = cut(new.select("cell", F.lit(n).cast("bigint").alias("level")), "levels")
        if front.isEmpty():
            break
        seen.add(front)
    return seen.all()


def visit(neighbours: dict[int, list[int]], start: int, most: int | None = None) -> list[int]:
    """First-in, first-out order from one start, at most so many."""
    order, seen, queue = [], {start}, deque([start])
    while queue and (most is None or len(order) < most):
        c = queue.popleft()
        order.append(c)
        for x in neighbours.get(c, ()):
            if x not in seen:
                seen.add(x)
                queue.append(x)
    return order


def orders(ranked: DataFrame, starts: DataFrame, sizes: DataFrame, bound: int = 250_000, grid: Grid | None = None, window: int = 1_000_000) -> DataFrame:
    """(component, cell, place from 1): the first-in, first-out order of each component from its start.

    ranked: (component, i, o, j), o being the order in which neighbours are visited. starts: (component, cell).
    sizes: (component, n). Components of at most ``bound`` cells go to one task each, which a group of that bound
    fits; larger ones go level by level over the cluster, a cell's place following its first parent's, then o. With
    their grid, where o is the place of a step of ``weights.steps``, they go many levels at a time: a task a component
    takes the tiles around the last level, up to ``window`` cells of them.
    """
    small = sizes.where(F.col("n") <= bound).select("component")
    joined = ranked.join(small, "component", "left_semi").join(starts.withColumnRenamed("cell", "start"), "component")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "o"], kind="stable")
        near: dict[int, list[int]] = {}
        for i, j in zip(pdf["i"].tolist(), pdf["j"].tolist()):
            near.setdefault(i, []).append(j)
        found = visit(near, int(pdf["start"].iloc[0]))
        return pd.DataFrame({"component": pdf["component"].iloc[0], "cell": found, "place": range(1, len(found) + 1)})

    kind = starts.schema["component"].dataType.simpleString()
    out = joined.groupBy("component").applyInPandas(one, f"component {kind}, cell long, place long")
    alone = starts.join(ranked.select("component").distinct(), "component", "left_anti").select("component", "cell", F.lit(1).cast("bigint").alias("place"))
    out = out.unionByName(alone)
    large = sizes.where(F.col("n") > bound).select("component")
    if not large.isEmpty():
        own, begin = ranked.join(large, "component", "left_semi"), starts.join(large, "component", "left_semi")
        out = out.unionByName(_by_level(own, begin) if grid is None else _by_windows(own, begin, grid, window))
    return out


#: Cells of a front that one task ranks.
MOST_FRONT = 1_000_000


def _next_level(ranked: DataFrame, front: DataFrame, seen: DataFrame, last: DataFrame) -> DataFrame | None:
    """(component, cell, place) of the level after ``front``; None if there is none. Within a level, the place of the
    first parent to reach a cell counts, then the step from it. last: (component, last), the places that are taken."""
    reach = ranked.join(front.select("component", F.col("cell").alias("i"), "place"), ["component", "i"]).select("component", F.col("j").alias("cell"), F.struct("place", "o").alias("by"))
    new = cut(reach.groupBy("component", "cell").agg(F.min("by").alias("by")).join(seen.select("component", "cell"), ["component", "cell"], "left_anti"), "front")
    n = new.count()
    if not n:
        return None
    if n <= MOST_FRONT:
        rank = new.withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy("by")))
    else:
        from gridloom.graph.scenarios import numbered

        all_ = numbered(new.withColumn("key", F.struct("component", "by")), "key", "rank").drop("key")
        rank = all_.join(all_.groupBy("component").agg(F.min("rank").alias("low")), "component").withColumn("rank", F.col("rank") - F.col("low") + 1)
    return rank.join(last, "component").select("component", "cell", (F.col("last") + F.col("rank")).alias("place"))


def _by_level(ranked: DataFrame, starts: DataFrame) -> DataFrame:
    """A job a level, of which the cells alone are written. Fronts are ranked by component; large ones in ranges over
    the cluster."""
    ranked = cut(ranked, "ranked")
    front = cut(starts.select("component", "cell", F.lit(1).cast("bigint").alias("place")), "places")
    seen, last = Pieces(front), cut(starts.select("component", F.lit(1).cast("bigint").alias("last")), "last")
    while (found := _next_level(ranked, front, seen.all(), last)) is not None:
        front = cut(found, "places")
        seen.add(front)
        more = front.groupBy("component").agg(F.max("place").alias("more"))
        last = cut(last.join(more, "component", "left").select("component", F.greatest("last", "more").alias("last")), "last")
    return seen.all()


#: Rows and columns of the tiles that windows are made of.
TILE = 32


def _window(held: dict[tuple, int], left: dict[tuple, int], front: set[tuple], most: int) -> tuple[set[tuple], int | None]:
    """Tiles around those of the front, and the levels that stay within them: TILE for each ring of tiles, as a step
    moves by one row and column at most; None if all that is left lies within, 0 if one ring has too many cells. Tiles
    without a cell left are passed by: what follows the front is reached through cells that are left."""
    within, ring, rings, n = set(front), set(front), 0, sum(held[t] for t in front)
    while True:
        grown = {t for r, c in ring for t in ((r + dr, c + dc) for dr, dc in weights.QUEEN) if left.get(t) and t not in within}
        if not grown:
            return within, None if n <= most else 0
        n += sum(held[t] for t in grown)
        if n > most:
            return within, rings * TILE
        within, ring, rings = within | grown, grown, rings + 1


def _by_windows(ranked: DataFrame, starts: DataFrame, grid: Grid, most: int) -> DataFrame:
    """Many levels a job: one task a component goes on from its last two levels within a window of tiles; cells of
    levels before have no neighbour that is new. A level whose window is too large for a task goes over the cluster.

    The driver holds the number of cells of each tile, one for TILE * TILE cells of the lattice."""
    spark, cols, kind = starts.sparkSession, grid.cols, starts.schema["component"].dataType.simpleString()
    tiled = lambda df: df.withColumns({"tr": F.floor((row_of(F.col("cell"), cols) - 1) / TILE), "tc": F.floor((col_of(F.col("cell"), cols) - 1) / TILE)})
    ways = ranked.groupBy("component", F.col("i").alias("cell")).agg(F.expr("bit_or(shiftleft(1, CAST(o AS INT)))").cast("bigint").alias("ways"))
    cells = cut(tiled(ways).repartitionByRange("component", "tr", "tc").sortWithinPartitions("component", "tr", "tc"), "cells")

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by("cell")
        cell, ways = (group.column(c).to_numpy() for c in ("cell", "ways"))
        known = group.column("place").is_valid().to_numpy()
        place, level = (group.column(c).fill_null(-1).to_numpy() for c in ("place", "level"))
        n, top, last = len(cell), int(level.max()), int(place.max())
        near = np.full((n, len(weights.QUEEN)), -1, np.int32)
        for o, (dr, dc) in enumerate(weights.QUEEN):
            has = np.flatnonzero(ways >> o & 1)
            to = cell[has] + dr * cols + dc
            at = np.minimum(np.searchsorted(cell, to), n - 1)
            there = cell[at] == to
            near[has[there], o] = at[there]
        front = np.flatnonzero(level == top)
        front, first, found, most_levels = front[np.argsort(place[front])], np.empty(n, np.int32), [], group.column("levels")[0].as_py()
        while most_levels is None or len(found) < most_levels:
            met = near[front].ravel()  # by parents' places, then steps
            met = met[met >= 0]
            met = met[~known[met]]
            if not met.size:
                break
            first[met[::-1]] = np.arange(met.size - 1, -1, -1)
            front = met[first[met] == np.arange(met.size)]
            known[front] = True
            found.append(front)
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        levels_ = np.repeat(np.arange(top + 1, top + 1 + len(found)), [len(f) for f in found])
        component = group.column("component")
        return pa.table({"component": pa.repeat(component[0], len(at)), "cell": cell[at], "place": pa.array(np.arange(last + 1, last + 1 + len(at)), pa.int64()), "level": pa.array(levels_, pa.int64())})

    def tiles(df: DataFrame) -> dict:
        """By component: (tile, number of rows, highest level) of each tile."""
        out: dict = {}
        for r in df.groupBy("component", "tr", "tc").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("top")).collect():
            out.setdefault(r["component"], []).append(((r["tr"], r["tc"]), r["n"], r["top"]))
        return out

    held = {c: {t: n for t, n, _ in of} for c, of in tiles(cells.withColumn("level", F.lit(0))).items()}
    left = {c: dict(of) for c, of in held.items()}
    state = cut(tiled(starts.select("component", "cell", F.lit(1).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("level"))), "places")
    seen, fronts, tops, edges = Pieces(state), {}, {}, None

    def took(new: DataFrame, planned: dict) -> None:
        """Notes what is left, and the fronts of components that may go on."""
        fronts.clear()
        for c, of in tiles(new).items():
            top = max(x[2] for x in of)
            for t, n, _ in of:
                left[c][t] -= n
            if planned[c] is not None and top == planned[c]:
                fronts[c], tops[c] = {t for t, _, x in of if x == top}, top

    took(state, dict.fromkeys(held, 0))
    while fronts:
        plans = {c: _window(held[c], left[c], front, most) for c, front in fronts.items()}
        planned = {c: None if levels_ is None else tops[c] + max(1, levels_) for c, (_, levels_) in plans.items()}
        wide = [c for c, (_, levels_) in plans.items() if levels_ == 0]
        parts = []
        if len(wide) < len(plans):
            of = [(c, *t, levels_) for c, (within, levels_) in plans.items() if levels_ != 0 for t in within]
            chosen = spark.createDataFrame(of, f"component {kind}, tr long, tc long, levels long")
            rows = [r for _, r, _, _ in of]
            around = cells.where(F.col("tr").between(min(rows), max(rows))).join(F.broadcast(chosen), ["component", "tr", "tc"]).select("component", "cell", "ways", "levels")
            around = around.join(state.select("component", "cell", "place", "level"), ["component", "cell"], "left")
            parts.append(cut(tiled(around.groupBy("component").applyInArrow(grow, f"component {kind}, cell long, place long, level long")), "places"))
        if wide:
            edges = cut(ranked, "ranked") if edges is None else edges
            own = state.join(F.broadcast(spark.createDataFrame([(c, tops[c]) for c in wide], f"component {kind}, at long")), "component")
            front = own.where("level = at")
            found = _next_level(edges, front, own, front.groupBy("component").agg(F.max("place").alias("last")))
            if found is not None:
                parts.append(cut(tiled(found.join(own.select("component", (F.col("at") + 1).alias("level")).distinct(), "component").select("component", "cell", "place", "level")), "places"))
        if not parts:
            break
        new, before = _union(parts), state
        for p in parts:
            seen.add(p)
        took(new, planned)
        if fronts:
            going = F.broadcast(spark.createDataFrame(list(tops.items()), f"component {kind}, at long"))
            state = cut(new.unionByName(before).join(going, "component").where("level >= at - 1").drop("at"), "state")
    return seen.all().select("component", "cell", "place")
