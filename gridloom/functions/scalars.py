"""Column expressions and small driver-side functions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_of(cell: Column, cols: int) -> Column:
    """1-based row of a 1-based, row-major cell number."""
    return F.floor((cell - 1) / F.lit(cols)).cast("bigint") + 1


def col_of(cell: Column, cols: int) -> Column:
    return F.pmod(cell - 1, F.lit(cols)).cast("bigint") + 1


def cell_of(row: Column, col: Column, cols: int) -> Column:
    return ((row - 1) * F.lit(cols) + col).cast("bigint")


def inside(row: Column, col: Column, rows: int, cols: int) -> Column:
    """Without this the last column of a row would touch the first of the next."""
    return row.between(1, rows) & col.between(1, cols)


def present(value: Column) -> Column:
    """NULL and NaN both count as missing; zero and negative values don't."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def finite(value: Column) -> Column:
    """The value, or null where it is null, NaN or infinite: what medians and maxima of measurements look at."""
    x = value.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def signs(cell: Column, probe: int, seed: int) -> Column:
    """+1 or -1 for a cell, by a non-linear mix in whole numbers that SQL and NumPy repeat exactly."""
    p = 2147483647
    c = F.pmod(cell.cast("bigint"), F.lit(p))
    h = F.pmod(c * 1103515245 + F.lit(probe * 104729 + seed * 15485863), F.lit(p))
    h = F.pmod(h * h + F.lit(probe * 7919 + 12345), F.lit(p))
    h = F.pmod(h * 48271 + c, F.lit(p))
    h = F.pmod(h * h, F.lit(p))
    return F.when(F.pmod(F.shiftright(h.cast("bigint"), 16), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def shuffled(cell: Column, seed: int) -> Column:
    """A whole number by which to order cells at random, repeatable in SQL; break ties by the cell."""
    p = 2147483647
    c = F.pmod(cell.cast("bigint"), F.lit(p))
    h = F.pmod(c * 1103515245 + F.lit(seed * 15485863 + 12345), F.lit(p))
    h = F.pmod(h * h + F.lit(7919), F.lit(p))
    h = F.pmod(h * 48271 + c, F.lit(p))
    return F.pmod(h * h, F.lit(p))


def two_sided_p(z: float | None) -> float | None:
    """2 * Phi(-|z|)."""
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def upper_p(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else 0.5 * math.erfc(z / math.sqrt(2))


def shown_p(p: float | None, digits: int = 4, floor: float = 1e-16) -> str | None:
    """A p-value for display."""
    return None if p is None else f"<{floor:g}" if p < floor else f"{p:.{digits}g}"


def proportions(given: list[float]) -> list[float]:
    """Sorted distinct shares in (0, 1]; if all are over 1 they are percentages."""
    values = [float(x) for x in given]
    if not values:
        raise ValueError("no proportion given")
    if all(x > 1 for x in values):
        values = [x / 100 for x in values]
    if any(not 0 < x <= 1 for x in values):
        raise ValueError(f"proportions must lie in (0, 1]: {given}")
    return sorted(set(values))


def share_label(share: float) -> str:
    """0.0001 -> 0p01pct, 0.1 -> 10pct."""
    text = f"{share * 100:.6f}".rstrip("0").rstrip(".")
    return text.replace(".", "p") + "pct"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All fractional columns rounded, half up."""
    real = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    return df.select(*[F.round(c, digits).alias(c) if c in real else F.col(c) for c in df.columns])


def numbers(df: DataFrame, texts: list[str]) -> DataFrame:
    """Every column but ``texts`` as double; what isn't a number becomes null without a word."""
    return df.select(*[F.col(c) if c in texts else F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in df.columns])


def with_megabytes(df: DataFrame) -> DataFrame:
    """Each bytes_* and peak_object_bytes column gets a twin in MB (1024 squared)."""
    twins = {(c[: -len("bytes")] + "mb" if c.endswith("_bytes") else c + "_mb"): F.col(c) / 1048576.0 for c in df.columns if c.startswith("bytes_") or c.endswith("_bytes")}
    return df.withColumns(twins)


def only(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def without_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.removesuffix(suffix) for c in df.columns if c.endswith(suffix)})


def fill_union(frames: list[DataFrame]) -> DataFrame:
    """All rows, with the union of the columns; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_text(value: Column) -> Column:
    """Distinct non-empty strings of a group, sorted and joined."""
    return F.array_join(F.sort_array(F.collect_set(F.when(F.length(value) > 0, value))), " | ")


# Words in messages by which a failure is hard (out of resources or time), and known soft ones.
HARD = [
    "cannot allocate", "memory exhausted", "out of memory", "vector memory exhausted", "negative length vectors", "long vectors not supported", "integer overflow", "timeout",
    "reached elapsed time limit", "allocation failure", "std::bad_alloc",
]
SOFT = ["subscript out of bounds", "dimnames", "names do not match", "invalid.*argument", "missing value where true/false needed"]
#: What Spark and the JVM say instead.
HARD_HERE = ["outofmemory", "java heap space", "gc overhead", "time ?limit", "timed out", "executor lost", "no space left"]
SOFT_HERE = ["not found", "missing"]


def failure_class(error: Column, warning: Column, hard: str = "|".join(HARD + HARD_HERE), soft: str = "|".join(SOFT + SOFT_HERE)) -> Column:
    """hard or soft (the default) for a failed run; null where there is neither error nor warning."""
    text = F.lower(F.concat_ws(" ", error, warning))
    return F.when(F.length(text) == 0, None).when(text.rlike(hard), "hard").when(text.rlike(soft), "soft").otherwise("soft")


def critical(warnings: list[str], patterns: list[str]) -> bool:
    return any(re.search(p, w, re.I) for w in warnings for p in patterns)
