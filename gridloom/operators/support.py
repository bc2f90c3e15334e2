"""Common support of layers, designs on it, and its descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import present
from gridloom.sources.cells import LAYERS, Grid, RESAMPLING


def valid(layers: list[str] | None = None) -> Column:
    """All layers present."""
    out = F.lit(True)
    for n in layers or LAYERS:
        out = out & present(F.col(n))
    return out


def common_support(cells: DataFrame, layers: list[str] | None = None, check: bool = False) -> DataFrame:
    """The cells where no layer is missing (null or NaN). check: an empty support is an error, at the cost of a job."""
    out = cells.where(valid(layers))
    if check and out.isEmpty():
        raise ValueError("no cell has all layers")
    return out


def align(parts: dict[str, DataFrame], template: DataFrame, grid: Grid, grids: dict[str, Grid] | None = None, methods: dict[str, str] | None = None) -> DataFrame:
    """Layers (cell, value) side by side on the template's cells: (cell, row, col, <layer>...).

    A layer with a grid of its own is resampled to the template first, each by its method: "near" or "bilinear".
    """
    out = template
    for name, df in parts.items():
        method = (methods or {}).get(name, "near")
        if method not in RESAMPLING:
            raise ValueError(f"resampling by {method} isn't known")
        own = (grids or {}).get(name)
        df = RESAMPLING[method](template, grid, df, own) if own else df
        out = out.join(df.select("cell", F.col("value").cast("double").alias(name)), "cell", "left")
    return out


def checked_cells(cells: DataFrame, size: int) -> DataFrame:
    """Distinct cell numbers in order; none at all, or one outside 1..size, is an error."""
    seen = cells.agg(F.count("cell").alias("n"), F.min("cell").alias("a"), F.max("cell").alias("b")).first()
    if not seen["n"]:
        raise ValueError("no cell given")
    if seen["a"] < 1 or seen["b"] > size:
        raise ValueError(f"cells must lie in 1..{size}")
    return cells.select("cell").distinct().orderBy("cell")


def dimension_table(cells: DataFrame, by: str = "region", sizes: dict | None = None) -> DataFrame:
    """A row a region: extent, cells, present cells of each layer and of all. sizes: (rows, cols) by region, else the
    extent of its cells."""
    counts = [F.count(F.when(present(F.col(n)), 1)).alias(f"non_na_{n}") for n in LAYERS]
    out = cells.groupBy(by).agg(
        (F.max("row") - F.min("row") + 1).alias("rows"), (F.max("col") - F.min("col") + 1).alias("cols"), *counts, F.count(F.when(valid(), 1)).alias("common_support_cells")
    )
    if sizes:
        known = cells.sparkSession.createDataFrame([(k, r, c) for k, (r, c) in sizes.items()], f"{by} {cells.schema[by].dataType.simpleString()}, rows long, cols long")
        out = out.drop("rows", "cols").join(F.broadcast(known), by, "left")
    return out.select(by, "rows", "cols", (F.col("rows") * F.col("cols")).alias("total_grids"), *[f"non_na_{n}" for n in LAYERS], "common_support_cells")


def support_summary(dataset: str, template_cells: int, support: DataFrame, retained: DataFrame, mndwi: bool = True) -> DataFrame:
    """One row: sizes and shares of the support and of what is left of it without isolated cells."""
    both = support.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(retained.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    total = F.lit(template_cells).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return both.agg(F.coalesce(F.sum("a"), zero).alias("common_support_cells"), F.coalesce(F.sum("b"), zero).alias("retained_cells")).select(
        F.lit(dataset).alias("dataset"), F.lit(mndwi).alias("mndwi_included"), total.alias("total_template_cells"), "common_support_cells", "retained_cells",
        (F.col("common_support_cells") - F.col("retained_cells")).alias("dropped_isolates"), (F.col("common_support_cells") / total).alias("share_common_support"), (F.col("retained_cells") / total).alias("share_retained_cells"),
    )


def design(sample: DataFrame, transform: Callable[[Column], Column] = F.log1p, response: str = "gdp", predictors: list[str] | None = None, scale: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(cell, y, intercept, <predictors>): the response transformed, predictors centred and divided by their sample
    standard deviation over these rows (a constant one becomes 0). The means and deviations come from one aggregate."""
    predictors = predictors or ["pop", "ndvi", "mndwi"]
    keep = keep or ["cell"]
    base = sample.select(*keep, transform(F.col(response)).alias("y"), F.lit(1.0).alias("intercept"), *[F.col(p).cast("double").alias(p) for p in predictors])
    if not scale:
        return base
    stats = sample.agg(*[F.avg(p).alias(f"m_{p}") for p in predictors], *[F.stddev_samp(p).alias(f"s_{p}") for p in predictors]).first()
    scaled = lambda p: (F.col(p) - stats[f"m_{p}"]) / stats[f"s_{p}"] if stats[f"s_{p}"] else F.lit(0.0)
    return base.select(*keep, "y", "intercept", *[scaled(p).alias(p) for p in predictors])
