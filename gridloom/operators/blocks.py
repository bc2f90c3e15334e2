"""Standard errors by refitting the model on connected blocks of cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import shuffled
from gridloom.graph.search import visit
from gridloom.operators import models, traces
from gridloom.operators.weights import degrees, steps
from gridloom.runtime import cut
from gridloom.sources.cells import Grid


def block_starts(cells: DataFrame, k: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(block, cell, row, col) of k start cells, first in a shuffled order."""
    rows = cells.select("cell", "row", "col", shuffled(F.col("cell"), seed).alias("h")).orderBy("h", "cell").limit(k).collect()
    return [(b, r["cell"], r["row"], r["col"]) for b, r in enumerate(rows)]


def grow(near: pd.DataFrame, grid: Grid, contiguity: str, start: int, m: int, radius: int) -> tuple[list[int], bool]:
    """The m cells first reached from the start, neighbours by ascending number; and whether the window of ``radius``
    was wide enough: no cell at its rim was expanded before the block was full."""
    known = dict(zip(near["cell"], zip(near["row"], near["col"])))
    at = {v: k for k, v in known.items()}
    around = {c: sorted(x for dr, dc in steps(contiguity) if (x := at.get((r + dr, k + dc))) is not None) for c, (r, k) in known.items()}
    cells = visit(around, start, m)
    r0, c0 = known[start]

    def rim(c: int) -> bool:
        r, k = known[c]
        return abs(r - r0) == radius and 1 < r < grid.rows or abs(k - c0) == radius and 1 < k < grid.cols

    return cells, not any(rim(c) for c in cells)


def draws(sample: DataFrame, edge: DataFrame, grid: Grid, model: str = "sar", k: int = 30, m: int = 500, seed: int = 123, contiguity: str = "queen", kmax: int = 40, probes: int = 20, min_block: int = 0, predictors: list[str] | None = None) -> DataFrame:
    """(block, size, rho, coef1..coefp): the model refitted on k blocks of m cells.

    sample: (cell, row, col, y, intercept, <x...>) of cells with neighbours. A window of cells around each start goes
    to one task, at most (2 radius + 1)^2 cells; the window doubles for the blocks that reached its rim. Weights are
    those of the whole support, not standardised again. Blocks end early where a component is used up.
    """
    spark = sample.sparkSession
    predictors = predictors or [c for c in sample.columns if c not in ("cell", "row", "col", "y", "intercept")]
    names = ["intercept", *predictors, *([f"W_{p}" for p in predictors] if model == "sdm" else [])]
    rows = cut(sample.join(degrees(edge).select("cell", "degree"), "cell"), "block-rows")
    todo, radius = block_starts(rows, k, seed), max(2, math.ceil(math.sqrt(m)))
    schema = "block int, size int, complete boolean, rho double, " + ", ".join(f"coef{i} double" for i in range(1, len(names) + 1))
    done = []
    while todo:
        starts = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(c).alias("start"), F.lit(r).alias("r"), F.lit(q).alias("c")) for b, c, r, q in todo])
        reach = F.lit(radius)
        hit = F.filter(starts, lambda s: (F.abs(F.col("row") - s["r"]) <= reach) & (F.abs(F.col("col") - s["c"]) <= reach))
        window = rows.withColumn("_hit", F.explode(hit)).select(*rows.columns, F.col("_hit.block").alias("block"), F.col("_hit.start").alias("start"))

        width = radius

        def refit(pdf: pd.DataFrame) -> pd.DataFrame:
            cells, complete = grow(pdf, grid, contiguity, int(pdf["start"].iloc[0]), m, width)
            whole = 2 * width >= max(grid.rows, grid.cols)
            b = pdf.set_index("cell").loc[sorted(cells)]
            values = [math.nan] * (1 + len(names))
            if complete or whole:
                values = _fit(b, names, predictors, contiguity, model, kmax, probes, seed + int(pdf["block"].iloc[0]))
            return pd.DataFrame([[int(pdf["block"].iloc[0]), len(b), bool(complete or whole), *values]], columns=[x.split()[0] for x in schema.split(", ")])

        got = window.groupBy("block").applyInPandas(refit, schema).collect()
        done += [r for r in got if r["complete"]]
        again = {r["block"] for r in got if not r["complete"]}
        todo, radius = [t for t in todo if t[0] in again], 2 * radius
    kept = [(r["block"], r["size"], r["rho"], *[r[f"coef{i}"] for i in range(1, len(names) + 1)]) for r in sorted(done, key=lambda r: r["block"]) if r["size"] >= min_block]
    return spark.createDataFrame(kept, "block int, size int, rho double, " + ", ".join(f"coef{i} double" for i in range(1, len(names) + 1)))


def _fit(b: pd.DataFrame, names: list[str], predictors: list[str], contiguity: str, model: str, kmax: int, probes: int, seed: int) -> list[float]:
    place = {rc: n for n, rc in enumerate(zip(b["row"], b["col"]))}
    w = np.zeros((len(b), len(b)))
    for n, (r, c, d) in enumerate(zip(b["row"], b["col"], b["degree"])):
        for dr, dc in steps(contiguity):
            if (j := place.get((r + dr, c + dc))) is not None:
                w[n, j] = 1 / d
    x = b[["intercept", *predictors]].to_numpy(float)
    if model == "sdm":
        x = np.hstack([x, w @ x[:, 1:]])
    full = np.column_stack([x, b["y"], w @ b["y"]])
    try:
        f = models.fit(models.from_products(names, len(b), full.T @ full), traces.sample_traces(w, kmax, probes, seed), model, predictors)
    except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):
        return [math.nan] * (1 + len(names))
    return [f.rho, *map(float, f.beta)]


def scaled(block_draws: DataFrame, n: int) -> dict:
    """Means and standard errors over the blocks, coefficients first and rho last: deviations times the root of the
    mean block size over n. k rows come to the driver."""
    rows = [r for r in block_draws.collect() if not math.isnan(r["rho"])]
    if not rows:
        return {"mean": [], "se": [], "size": 0.0}
    p = sum(c.startswith("coef") for c in block_draws.columns)
    data = np.array([[*(r[f"coef{i}"] for i in range(1, p + 1)), r["rho"]] for r in rows], float)
    size = float(np.mean([r["size"] for r in rows]))
    sd = data.std(0, ddof=1) if len(rows) > 1 else np.full(p + 1, math.nan)
    return {"mean": data.mean(0).tolist(), "se": (sd * math.sqrt(size / n)).tolist(), "size": size}
