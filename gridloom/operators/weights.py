"""Contiguity weights as edge tables (i, j, w), by three interchangeable routes, and algebra on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import cell_of, col_of, inside, row_of
from gridloom.runtime import cut, release
from gridloom.sources.cells import Grid

# Steps to the neighbours (row, column) in the order that searches visit them.
ROOK = [(-1, 0), (1, 0), (0, -1), (0, 1)]
QUEEN = [*ROOK, (-1, -1), (-1, 1), (1, -1), (1, 1)]


def steps(contiguity: str) -> list[tuple[int, int]]:
    if contiguity not in ("queen", "rook"):
        raise ValueError(f"contiguity is queen or rook, not {contiguity}")
    return QUEEN if contiguity == "queen" else ROOK


def directions(contiguity: str) -> int:
    return len(steps(contiguity))


def candidates(cells: DataFrame, grid: Grid, moves: list[tuple[int, int, int]], keys: list[str]) -> DataFrame:
    """(keys, i, o, j): of each cell the neighbours within the grid; no join, only arithmetic."""
    moved = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), (F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c")) for o, dr, dc in moves])).alias("s")
    return cells.select(*keys, F.col("cell").alias("i"), moved).where(inside(F.col("s.r"), F.col("s.c"), grid.rows, grid.cols)).select(*keys, "i", F.col("s.o").alias("o"), cell_of(F.col("s.r"), F.col("s.c"), grid.cols).alias("j"))


def edges(support: DataFrame, grid: Grid, contiguity: str = "queen", keys: list[str] | None = None, ranked: bool = False) -> DataFrame:
    """(keys, i, j, w = 1) between neighbouring cells of the support (row, col and cell are needed; cells distinct).

    The default route. Neighbours are symmetric, so only half the steps are looked up, by one equi-join on the cell,
    and each edge found is turned around. ranked: also o, the place of the step in visiting order.
    """
    keys = keys or []
    all_steps = steps(contiguity)
    back = {n: all_steps.index((-dr, -dc)) for n, (dr, dc) in enumerate(all_steps)}
    half = [(n, dr, dc) for n, (dr, dc) in enumerate(all_steps) if (dr, dc) > (0, 0)]
    found = candidates(support, grid, half, keys).join(support.select(*keys, F.col("cell").alias("j")), [*keys, "j"], "left_semi")
    other = F.element_at(F.create_map(*[F.lit(x) for n, b in back.items() for x in (n, b)]), F.col("o"))
    both = F.explode(F.array(F.struct("i", "j", "o"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), other.alias("o")))).alias("e")
    out = found.select(*keys, both).select(*keys, "e.i", "e.j", *(["e.o"] if ranked else []))
    return out.withColumn("w", F.lit(1.0))


def lattice_edges(grid: Grid, contiguity: str, template: DataFrame) -> DataFrame:
    """(i, j, w = 1) of the full lattice."""
    moves = [(n, dr, dc) for n, (dr, dc) in enumerate(steps(contiguity))]
    return candidates(template, grid, moves, []).select("i", "j", F.lit(1.0).alias("w"))


def project(edge: DataFrame, support: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The edges with both ends in the support."""
    keys = keys or []
    cells = support.select(*keys, "cell")
    return edge.join(cells.withColumnRenamed("cell", "i"), [*keys, "i"], "left_semi").join(cells.withColumnRenamed("cell", "j"), [*keys, "j"], "left_semi").select(*edge.columns)


def edges_by_projection(support: DataFrame, grid: Grid, template: DataFrame, contiguity: str = "queen") -> DataFrame:
    """Route 1: the full lattice's matrix, projected to the support."""
    return project(lattice_edges(grid, contiguity, template), support)


def edges_by_scan(support: DataFrame, grid: Grid, contiguity: str = "queen", chunk: int = 500_000) -> DataFrame:
    """Route 3: all pairs of neighbouring template cells, scanned in chunks of the cell range, filtered at both ends."""
    spark = support.sparkSession
    ids = spark.range(1, grid.size + 1, 1, max(1, -(-grid.size // chunk)))
    cells = ids.select(F.col("id").alias("cell"), row_of(F.col("id"), grid.cols).alias("row"), col_of(F.col("id"), grid.cols).alias("col"))
    return project(lattice_edges(grid, contiguity, cells), support)


def no_edges(spark) -> DataFrame:
    return spark.createDataFrame([], "i long, j long, w double")


def degrees(edge: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, cell, degree, weight) of the cells that have an edge."""
    keys = keys or []
    return edge.groupBy(*keys, F.col("i").alias("cell")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))


def isolates(support: DataFrame, edge: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return support.join(edge.select(*keys, F.col("i").alias("cell")), [*keys, "cell"], "left_anti")


def retained(support: DataFrame, edge: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return support.join(edge.select(*keys, F.col("i").alias("cell")), [*keys, "cell"], "left_semi")


def row_standardised(edge: DataFrame, keys: list[str] | None = None, tolerance: float = 0.0, symmetric: bool = False) -> DataFrame:
    """Weights that sum to 1 in each row. Explicit zeros go; rows without a positive sum go with their columns, as do
    isolated cells. symmetric: the weights are contiguity's, where such rows have no edge, so that no column needs to
    be looked for. At most as many edges as there are steps share a row, so the window is small."""
    keys = keys or []
    left = edge.where(F.abs("w") > tolerance)
    share = F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "i"))
    if symmetric:
        return left.withColumn("w", share)
    rows = left.groupBy(*keys, F.col("i").alias("j")).agg(F.sum("w").alias("s")).where("s > 0").select(*keys, "j")
    left = left.join(rows, [*keys, "j"], "left_semi").join(rows.withColumnRenamed("j", "i"), [*keys, "i"], "left_semi")
    return left.select(*edge.columns).withColumn("w", share)


def standardised_or_error(edge: DataFrame, symmetric: bool = True) -> DataFrame:
    """The same, where no edge at all, or a kept row whose columns all went, is an error."""
    if edge.isEmpty():
        raise ValueError("no cell has a neighbour")
    out = row_standardised(edge, symmetric=symmetric)
    if not symmetric:
        rows = edge.groupBy("i").agg(F.sum("w").alias("s")).where("s > 0")
        if not rows.join(out, "i", "left_anti").isEmpty() or not out.groupBy("i").agg(F.sum("w").alias("s")).where("s IS NULL OR isnan(s) OR s <= 0").isEmpty():
            raise ValueError("rows without a positive sum remain")
    return out


def neighbour_lists(edge: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, neighbours array<struct<j, w>>) in ascending order of j."""
    keys = keys or []
    return edge.groupBy(*keys, "i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("neighbours"))


def symmetrised(edge: DataFrame) -> DataFrame:
    """(i, j, w = 1) wherever either direction has a weight."""
    return edge.select("i", "j").union(edge.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct().withColumn("w", F.lit(1.0))


def lag(edge: DataFrame, values: DataFrame, columns: list[str], keys: list[str] | None = None, prefix: str = "W_") -> DataFrame:
    """(keys, cell, W_<column>...): the weighted sum over the neighbours, for all columns in one join and aggregate."""
    keys = keys or []
    z = values.select(*keys, F.col("cell").alias("j"), *columns)
    return edge.join(z, [*keys, "j"]).groupBy(*keys, F.col("i").alias("cell")).agg(*[F.sum(F.col("w") * F.col(c)).alias(prefix + c) for c in columns])


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row on whether two edge tables are the same matrix: one full outer join, one aggregate."""
    x, y = a.select("i", "j", F.col("w").alias("wa")), b.select("i", "j", F.col("w").alias("wb"))
    both = x.join(y, ["i", "j"], "full_outer")
    d = F.abs(F.coalesce("wa", F.lit(0.0)) - F.coalesce("wb", F.lit(0.0)))
    out = both.agg(
        F.count("wa").alias("nnz_a"), F.count("wb").alias("nnz_b"), F.coalesce(F.count_if(F.col("wa").isNull() | F.col("wb").isNull()), F.lit(0)).alias("unmatched"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs_diff"), F.count_if(d > tolerance).alias("diff_nnz"),
    )
    return out.select("nnz_a", "nnz_b", (F.col("nnz_a") == F.col("nnz_b")).alias("nnz_equal"), (F.col("unmatched") == 0).alias("structure_equal"), "max_abs_diff", "diff_nnz", ((F.col("unmatched") == 0) & (F.col("max_abs_diff") <= tolerance)).alias("equal_within_tol"))


def same_cells(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same set of cells."""
    x, y = a.select("cell").distinct(), b.select("cell").distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def solve(edge: DataFrame, values: DataFrame, rho: float, column: str, iterations: int = 60, cut_every: int = 10) -> DataFrame:
    """(cell, x): (I - rho W) x = b by x <- b + rho W x, which converges for |rho| < 1 and rows that sum to 1 at most.

    Every step is one join and aggregate; every few the vector is written to the shared folder.
    """
    if abs(rho) >= 1:
        raise ValueError("the iteration needs |rho| < 1")
    base = values.select("cell", F.col(column).alias("b"))
    x = base.select("cell", F.col("b").alias("x"))
    last = None
    for n in range(1, iterations + 1):
        moved = lag(edge, x, ["x"])
        x = base.join(moved, "cell", "left").select("cell", (F.col("b") + rho * F.coalesce("W_x", F.lit(0.0))).alias("x"))
        if n % cut_every == 0:
            x = cut(x, "solve")
            if last is not None:
                release(last)
            last = x
    return x
