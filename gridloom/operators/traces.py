"""Traces of powers of W, exact for low orders and by random signs, and the log-determinant series on them."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import signs
from gridloom.runtime import cut, release


def traces(edge: DataFrame, cells: DataFrame, kmax: int = 50, probes: int = 30, seed: int = 123, exact_low_order: bool = False) -> list[float]:
    """tr(W^k) for k = 1..kmax: the mean over random signs v of v' W^k v.

    All probes are columns of one table, so a power is one join and aggregate, written to the shared folder: no power
    is computed twice. exact_low_order puts the exact values in the first two places.
    """
    names = [f"z{b}" for b in range(probes)]
    start = cut(cells.select("cell", *[signs(F.col("cell"), b, seed).alias(f"v{b}") for b in range(probes)]), "signs")
    z, last, out = start.select("cell", *[F.col(f"v{b}").alias(f"z{b}") for b in range(probes)]), None, []
    for _ in range(kmax):
        moved = edge.join(z.withColumnRenamed("cell", "j"), "j").groupBy(F.col("i").alias("cell")).agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
        z = cut(moved, "powers")
        if last is not None:
            release(last)
        last = z
        row = start.join(z, "cell").agg(*[F.sum(F.col(f"v{b}") * F.col(f"z{b}")).alias(f"t{b}") for b in range(probes)]).first()
        out.append(sum(x or 0.0 for x in row) / probes)
    release(start, *([last] if last is not None else []))
    if exact_low_order:
        for r in exact_traces(edge, 2).collect():
            if r["k"] <= kmax:
                out[r["k"] - 1] = r["tr"]
    return out


def exact_traces(edge: DataFrame, upto: int = 3) -> DataFrame:
    """(k, tr) for k up to 3: no cell is its own neighbour, then closed walks of two and three steps by self-joins.
    Paths of two steps from a cell are at most 64, so the joins stay in proportion to the cells."""
    e = edge.select("i", "j", "w")
    one = e.where("i = j").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("tr")).select(F.lit(1).cast("bigint").alias("k"), "tr")
    back = e.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("w2"))
    two = e.join(back, ["i", "j"]).agg(F.coalesce(F.sum(F.col("w") * F.col("w2")), F.lit(0.0)).alias("tr")).select(F.lit(2).cast("bigint").alias("k"), "tr")
    out = one.unionByName(two) if upto >= 2 else one
    if upto >= 3:
        next_ = e.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("w").alias("w2"))
        home = e.select(F.col("i").alias("k"), F.col("j").alias("i"), F.col("w").alias("w3"))
        three = e.join(next_, "j").join(home, ["k", "i"]).agg(F.coalesce(F.sum(F.col("w") * F.col("w2") * F.col("w3")), F.lit(0.0)).alias("tr"))
        out = out.unionByName(three.select(F.lit(3).cast("bigint").alias("k"), "tr"))
    return out


def logdet(rho: float, tr: list[float]) -> float:
    """log det(I - rho W) from the series -sum rho^k tr_k / k."""
    return -sum(rho**k * t / k for k, t in enumerate(tr, 1))


def logdet_slope(rho: float, tr: list[float]) -> float:
    """tr((I - rho W)^-1 W) = sum rho^(k-1) tr_k, the negative of the log-determinant's slope."""
    return sum(rho ** (k - 1) * t for k, t in enumerate(tr, 1))


def logdet_bend(rho: float, tr: list[float]) -> float:
    """sum (k-1) rho^(k-2) tr_k, the negative of the second derivative."""
    return sum((k - 1) * rho ** (k - 2) * t for k, t in enumerate(tr, 1) if k > 1)


def mean_diagonal(rho: float, tr: list[float], n: int) -> float:
    """Mean diagonal of (I - rho W)^-1."""
    return (n + sum(rho**k * t for k, t in enumerate(tr, 1))) / n


def mean_row_sum(rho: float) -> float:
    """Mean row sum of (I - rho W)^-1 for rows that sum to 1."""
    return 1 / (1 - rho)


def warn_if_truncated(rho: float) -> None:
    if abs(rho) > 0.9:
        warnings.warn(f"rho is {rho:.3f}: the trace series converges slowly beyond 0.9", stacklevel=2)


def dense(edge: DataFrame, cells: DataFrame, most: int = 3_000) -> np.ndarray:
    """The matrix itself for exact work on small supports; more than ``most`` cells are an error."""
    ids = [r[0] for r in cells.select("cell").orderBy("cell").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"exact work is for {most} cells at most; use the trace series")
    at = {c: n for n, c in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in edge.select("i", "j", "w").collect():
        out[at[r["i"]], at[r["j"]]] = r["w"]
    return out


class Lines:
    """W by lines of the lattice (rows or columns, whichever hold fewer cells), for its exact log-determinant at any
    number of cells.

    A cell's neighbours lie in its own line and the two beside it, so I - rho W is block tridiagonal, and its
    determinant the product of those of as many small matrices as there are lines: memory in proportion to the edges
    and the square of a line's cells, on the driver. Lines of more than ``most`` cells are an error.
    """

    def __init__(self, edge: DataFrame, cells: DataFrame, most: int = 8_000):
        width = min((cells.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0, c) for c in ("row", "col"))
        if width[0] > most:
            raise ValueError(f"a line has {width[0]} cells, over {most}; use the trace series")
        line, other = width[1], "col" if width[1] == "row" else "row"
        at = cells.select(F.col(line).alias("line"), F.col(other).alias("place"), "cell").toPandas().sort_values(["line", "place"])
        self.n = len(at)
        numbers, own = np.unique(at["line"].to_numpy(), return_inverse=True)
        starts = np.searchsorted(own, np.arange(len(numbers)))
        self.sizes = np.diff(np.append(starts, self.n))
        order = np.argsort(at["cell"].to_numpy())
        known = at["cell"].to_numpy()[order]
        w = edge.select("i", "j", "w").toPandas()
        i, j = (order[np.searchsorted(known, w[c].to_numpy())] for c in ("i", "j"))
        self.blocks: dict[int, list[np.ndarray]] = {}
        step = own[j] - own[i]
        for d in (-1, 0, 1):
            mine = np.flatnonzero(step == d)
            mine = mine[np.argsort(own[i[mine]], kind="stable")]
            parts = np.searchsorted(own[i[mine]], np.arange(len(numbers) + 1))
            place = lambda x: x - starts[own[x]]
            self.blocks[d] = [np.stack([place(i[m]), place(j[m]), w["w"].to_numpy()[m]]) for m in (mine[a:b] for a, b in zip(parts, parts[1:]))]

    def _dense(self, line: int, d: int) -> np.ndarray:
        a, b, v = self.blocks[d][line]
        out = np.zeros((self.sizes[line], self.sizes[line + d] if d else self.sizes[line]))
        out[a.astype(int), b.astype(int)] = v
        return out

    def logdet(self, rho: float) -> float:
        """log det(I - rho W), line after line; -inf where the determinant isn't positive."""
        total, sign, last = 0.0, 1.0, None
        for line, size in enumerate(self.sizes):
            s = np.eye(size) - rho * self._dense(line, 0)
            if last is not None and self.blocks[-1][line].shape[1]:
                s -= rho * rho * self._dense(line, -1) @ np.linalg.solve(last, self._dense(line - 1, 1))
            one, value = np.linalg.slogdet(s)
            sign, total, last = sign * one, total + float(value), s
        return total if sign > 0 else -math.inf


def exact_logdet(rho: float, w: np.ndarray) -> float:
    """-inf where the determinant isn't positive."""
    sign, value = np.linalg.slogdet(np.eye(len(w)) - rho * w)
    return float(value) if sign > 0 else -math.inf


def power_traces(w: np.ndarray, kmax: int) -> list[float]:
    out, p = [], np.eye(len(w))
    for _ in range(kmax):
        p = p @ w
        out.append(float(np.trace(p)))
    return out


def sample_traces(w: np.ndarray, kmax: int, probes: int, seed: int) -> list[float]:
    """The random estimate for a small matrix, in NumPy."""
    v = np.random.default_rng(seed).choice([-1.0, 1.0], (len(w), probes))
    z, out = v, []
    for _ in range(kmax):
        z = w @ z
        out.append(float((v * z).sum() / probes))
    return out
