"""The three routes to the weights side by side: timed, compared, summarised."""

from __future__ import annotations

import platform
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import weights
from gridloom.runtime import cut, release, stored_bytes
from gridloom.sources import sinks
from gridloom.sources.cells import Grid, template

TEXTS = ["method", "status", "failure_stage", "failure_class", "error", "warning_message", "scenario", "terra_mode"]
ROUTES = ("projection", "support_edges", "full_scan")


@dataclass
class Timed:
    ok: bool
    value: object
    elapsed: float
    error: str
    warnings: list[str]


def timed(spark: SparkSession, work: Callable[[], object], timeout: float | None = None) -> Timed:
    """Run and time; errors are caught, and after ``timeout`` seconds the Spark jobs it started are cancelled."""
    import warnings as w

    tag, clock = f"timed-{uuid.uuid4().hex}", time.perf_counter()
    timer = threading.Timer(timeout, lambda: spark.interruptTag(tag)) if timeout else None
    with w.catch_warnings(record=True) as caught:
        w.simplefilter("always")
        spark.addTag(tag)
        if timer:
            timer.daemon = True
            timer.start()
        try:
            value, error = work(), ""
        except Exception as e:  # noqa: BLE001
            late = timeout is not None and time.perf_counter() - clock >= timeout
            value, error = None, f"reached elapsed time limit: {timeout:g} s" if late else f"{type(e).__name__}: {str(e)[:500]}"
        finally:
            spark.removeTag(tag)
            if timer:
                timer.cancel()
    return Timed(not error, value, time.perf_counter() - clock, error, [str(x.message)[:200] for x in caught])


def failed(method: str, stage: str, error: str, warnings: list[str], cells: int) -> dict:
    text = f"{error} {' '.join(warnings)}".lower()
    import re

    kind = "hard" if re.search("|".join(scalars.HARD + scalars.HARD_HERE), text) else "soft"
    return {"method": method, "status": "failed", "failure_stage": stage, "failure_class": kind, "error": error, "warning_message": " | ".join(warnings), "cells_input": cells}


def run_route(method: str, support: DataFrame, grid: Grid, contiguity: str = "queen", timeout: float | None = 7200, chunk: int = 500_000, keep: bool = False) -> tuple[dict, dict[str, DataFrame]]:
    """One route, stage by stage, each forced before its clock stops: raw edges, then pruned and standardised ones.

    Returns a row of sizes, times and bytes, and the two edge tables if ``keep``. Bytes of the weights are those that
    their tables take in the shared folder; bytes_lookup is what the route goes through beside them, 24 an edge of the
    lattice and 8 a cell.
    """
    spark, n = support.sparkSession, support.count()
    if method not in ROUTES:
        raise ValueError(f"no route {method}")
    build = {
        "projection": lambda: weights.edges_by_projection(support, grid, template(spark, grid), contiguity),
        "support_edges": lambda: weights.edges(support, grid, contiguity),
        "full_scan": lambda: weights.edges_by_scan(support, grid, contiguity, chunk),
    }[method]
    raw = timed(spark, lambda: cut(build(), "raw"), timeout)
    if not raw.ok:
        return failed(method, "build", raw.error, raw.warnings, n), {}
    nnz = raw.value.count()
    final = timed(spark, lambda: cut(weights.row_standardised(raw.value, symmetric=True), "final"), timeout)
    if not final.ok:
        return failed(method, "prune", final.error, final.warnings, n), {}
    left = final.value.select("i").distinct().count()
    common, stored = stored_bytes(raw.value), stored_bytes(final.value)
    pairs = (4 if contiguity == "rook" else 8) * grid.size
    held = {"projection": pairs * 24, "support_edges": n * 8, "full_scan": min(chunk, grid.size) * pairs // max(1, grid.size) * 24}[method]
    row = {
        "method": method, "status": "ok", "failure_stage": "", "failure_class": "", "error": "", "warning_message": " | ".join(raw.warnings + final.warnings), "cells_input": n, "cells_after_prune": left,
        "n_isolates": n - left, "nnz_common": nnz, "nnz_final": nnz, "elapsed_build": raw.elapsed, "elapsed_prune_std": final.elapsed, "elapsed_total": raw.elapsed + final.elapsed,
        "bytes_lookup": float(held), "bytes_w_common": float(common), "bytes_w_final": float(stored), "peak_object_bytes": float(max(held, common, stored)),
    }
    if method == "full_scan":
        row |= {"n_full_pairs_scanned": pairs, "terra_chunk_size": chunk, "terra_mode": "chunked" if chunk < grid.size else "single"}
    tables = {"common": raw.value, "final": final.value}
    if not keep:
        release(*tables.values())
    return row, tables if keep else {}


def validate(first: dict[str, DataFrame], other: dict[str, DataFrame], method: str, tolerance: float = 1e-12) -> dict:
    """Whether two routes gave the same matrices and the same retained cells."""
    if not first or not other:
        return {"comparator_method": method, "prop_ok": bool(first), "comparator_ok": bool(other), "output_equivalence_ok": False}
    out: dict = {"comparator_method": method, "prop_ok": True, "comparator_ok": True}
    for name in ("common", "final"):
        r = weights.compare(first[name], other[name], tolerance).first()
        out |= {f"{name}_equal": r["equal_within_tol"], f"{name}_structure_equal": r["structure_equal"], f"{name}_max_abs_diff": r["max_abs_diff"], f"{name}_diff_nnz": r["diff_nnz"], f"{name}_nnz_prop": r["nnz_a"], f"{name}_nnz_comparator": r["nnz_b"]}
    ends = [t["final"].select(F.col("i").alias("cell")) for t in (first, other)]
    out["keep_equal"] = weights.same_cells(*ends)
    out["output_equivalence_ok"] = out["common_equal"] and out["final_equal"] and out["keep_equal"]
    return out


def as_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows with different keys, as one table; what a row lacks is null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    kind = lambda n: "string" if n in TEXTS or n == "comparator_method" else next((("boolean" if isinstance(r[n], bool) else "bigint" if isinstance(r[n], int) else "double") for r in rows if r.get(n) is not None), "double")
    kinds = {n: kind(n) for n in names}
    cast = lambda n, v: None if v is None else float(v) if kinds[n] == "double" else v
    return spark.createDataFrame([tuple(cast(n, r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def run_benchmark(scenarios: DataFrame, support: DataFrame, grid: Grid, reps: int = 2, routes: tuple[str, ...] = ROUTES, contiguity: str = "queen", timeout: float | None = 7200, chunk: int = 500_000, out_dir: str | None = None, check: bool = True, patterns: list[str] | None = None) -> dict[str, DataFrame]:
    """Every scenario by every route, ``reps`` times; tables after each scenario and at the end."""
    spark, where = support.sparkSession, sinks.folders(out_dir)
    full = support.count()
    raw, checks = [], []
    for (name,) in scenarios.select("scenario").distinct().orderBy("scenario").collect():
        cells = cut(support.join(scenarios.where(F.col("scenario") == name).select("cell"), "cell", "left_semi"), "scenario")
        for rep in range(1, reps + 1):
            kept: dict[str, dict[str, DataFrame]] = {}
            for method in routes:
                row, kept[method] = run_route(method, cells, grid, contiguity, timeout, chunk, keep=check)
                if patterns and scalars.critical([row["warning_message"]], patterns):
                    row["status"] = "failed"
                row |= {"scenario": name, "rep": rep, "pct_support": 100.0 * row["cells_input"] / full}
                raw.append(row)
            if check and "projection" in routes:
                for method in routes[1:]:
                    checks.append({"scenario": name, "rep": rep} | validate(kept["projection"], kept[method], method))
            release(*[t for k in kept.values() for t in k.values()])
        release(cells)
        if where.progress:
            sinks.write_sheets({"raw": as_frame(spark, raw)}, where.progress, single=True)
    table = as_frame(spark, raw)
    summary = summarise(table)
    out = {"raw": table.orderBy("scenario", "method", "rep"), "summary": summary, "gain": gain(summary), "environment": environment(spark), "data_dictionary": dictionary(spark)}
    if checks:
        v = as_frame(spark, checks)
        out |= {"validation": v, "validation_summary": summarise_checks(v)}
    sinks.write_sheets(out, where.final, single=True)
    if where.final:
        sinks.write_sheets({f"{k}_csv": v for k, v in out.items()}, where.final, "csv", single=True)
    return out


def summarise(raw: DataFrame, by: tuple[str, ...] = ("scenario", "method")) -> DataFrame:
    """Counts of runs and the medians of the finite values of every number, by scenario and method."""
    numeric = [c for c, t in raw.dtypes if t in ("double", "bigint", "int", "float") and c not in ("rep", *by)]
    medians = [F.median(scalars.finite(F.col(c))).alias(c) for c in numeric]
    out = raw.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"), F.count_if(F.col("status") != "ok").alias("failed_runs"), *medians,
        scalars.distinct_text(F.col("error")).alias("failure_message"), scalars.distinct_text(F.col("warning_message")).alias("warning_messages"),
    )
    return scalars.with_megabytes(out).orderBy(*by)


def gain(summary: DataFrame, proposed: str = "projection") -> DataFrame:
    """The other methods against one: ratios of time and memory (over 1: the first is better) and who wins; where a
    ratio isn't finite the first is named, as its rival has no result."""
    keep = ["scenario", "pct_support", "method", "cells_input", "cells_after_prune", "nnz_final", "elapsed_total", "peak_object_mb", "ok_runs", "failed_runs", "failure_message"]
    base = scalars.only(summary, keep)
    mine = base.where(F.col("method") == proposed).select("scenario", F.col("elapsed_total").alias("elapsed_total_prop"), F.col("peak_object_mb").alias("peak_object_mb_prop"))
    both = base.where(F.col("method") != proposed).join(mine, "scenario", "left")
    t, m = scalars.finite(_over("elapsed_total")), scalars.finite(_over("peak_object_mb"))
    winner = lambda r: F.when(r < 1, F.col("method")).otherwise(F.lit(proposed))
    return both.select(
        *[c for c in ("scenario", "pct_support", "method", "cells_input", "cells_after_prune", "nnz_final") if c in base.columns], "elapsed_total_prop", "elapsed_total", t.alias("time_ratio_alt_over_prop"), winner(t).alias("faster_method"),
        "peak_object_mb_prop", "peak_object_mb", m.alias("memory_ratio_alt_over_prop"), winner(m).alias("lower_memory_method"), "ok_runs", "failed_runs", "failure_message",
    ).orderBy("scenario", "method")


def _over(name: str) -> Column:
    return F.when(F.col(f"{name}_prop") != 0, F.col(name) / F.col(f"{name}_prop"))


def summarise_checks(checks: DataFrame, by: tuple[str, ...] = ("scenario", "comparator_method")) -> DataFrame:
    """Per scenario and comparator: comparisons, how many agreed, whether all did (true if none could be made)."""
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True)).alias(f"all_{c}")
    flags = [c for c in ("common_equal", "final_equal", "keep_equal") if c in checks.columns]
    diffs = [c for c in checks.columns if c.endswith("_max_abs_diff")]
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("comparisons"), F.count_if("output_equivalence_ok").alias("equivalent"), *[every(c) for c in [*flags, "output_equivalence_ok"]],
        *[F.max(scalars.finite(F.col(c))).alias(f"max_{c}") for c in diffs], *[F.median(scalars.finite(F.col(c))).alias(f"median_{c}") for c in diffs],
    ).orderBy(*by)


def environment(spark: SparkSession) -> DataFrame:
    rows = {"spark": spark.version, "python": platform.python_version(), "host": platform.node(), "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "item string, value string")


MEANINGS = {
    "method": "route by which the weights were built", "status": "ok or failed", "failure_stage": "stage that failed", "failure_class": "hard: out of memory or time; soft: anything else",
    "error": "message", "warning_message": "warnings, joined", "cells_input": "cells of the scenario", "cells_after_prune": "cells with a neighbour", "n_isolates": "cells without",
    "nnz_common": "edges before pruning", "nnz_final": "edges after", "elapsed_build": "seconds to build the edges", "elapsed_prune_std": "seconds to prune and standardise",
    "elapsed_total": "their sum", "bytes_lookup": "modelled bytes of what the route holds beside its result", "bytes_w_common": "modelled bytes of the edges", "bytes_w_final": "modelled bytes of the final edges",
    "peak_object_bytes": "the largest of these; not memory of the process", "n_full_pairs_scanned": "pairs that the full scan looks at", "terra_chunk_size": "cells a chunk of it", "terra_mode": "single or chunked",
    "scenario": "share of the support", "rep": "repetition", "pct_support": "cells as per cent of the full support", "time_ratio_alt_over_prop": "over 1: the first route is faster",
    "memory_ratio_alt_over_prop": "over 1: it holds less", "faster_method": "by that ratio", "lower_memory_method": "by that ratio", "output_equivalence_ok": "same edges, weights and cells",
}


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MEANINGS.items()), "column_name string, description string")
