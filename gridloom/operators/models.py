"""Spatial autoregressive (SAR) and spatial Durbin (SDM) models by profile likelihood on one-pass moments."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import shown_p, two_sided_p
from gridloom.operators import traces as tr_
from gridloom.operators import weights

BOUNDS = (-0.99, 0.99)


@dataclass
class Moments:
    """Cross products of the columns [x..., y, Wy] over n rows."""

    names: list[str]
    n: int
    xx: np.ndarray
    xy: np.ndarray
    xl: np.ndarray
    yy: float
    yl: float
    ll: float


@dataclass
class Fit:
    model: str
    names: list[str]
    beta: np.ndarray
    rho: float
    sigma2: float
    vcov: np.ndarray
    se: np.ndarray
    se_rho: float | None
    loglik: float
    aic: float
    bic: float
    n: int
    traces: list[float]
    moments: Moments
    degenerate: bool = False
    impacts: list[dict] = field(default_factory=list)
    robust: dict[str, np.ndarray] = field(default_factory=dict)
    blocks: dict = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def model_rows(sample: DataFrame, edge: DataFrame, model: str = "sar", predictors: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(cell, <x...>, y, wy) and the names of x: intercept and predictors, for the SDM also their spatial lags.

    All lags come from one join and aggregate. Cells without a neighbour aren't in it.
    """
    predictors = predictors or [c for c in sample.columns if c not in ("cell", "y", "intercept")]
    moved = weights.lag(edge, sample, ["y", *(predictors if model == "sdm" else [])])
    out = sample.join(moved, "cell").withColumnRenamed("W_y", "wy")
    names = ["intercept", *predictors, *([f"W_{p}" for p in predictors] if model == "sdm" else [])]
    return out.select("cell", *names, "y", "wy"), names


def products(columns: list[str]) -> list:
    return [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]


def moments(rows: DataFrame, names: list[str]) -> Moments:
    """One aggregate, partial on the executors, of all the products that estimation needs."""
    columns = [*names, "y", "wy"]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *products(columns)).first()
    p = len(names)
    full = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p + 2)] for i in range(p + 2)], float)
    return from_products(names, got["n"], full)


def from_products(names: list[str], n: int, full: np.ndarray) -> Moments:
    p = len(names)
    return Moments(names, n, full[:p, :p], full[:p, p], full[:p, p + 1], full[p, p], full[p, p + 1], full[p + 1, p + 1])


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b by elimination, else least squares, else the pseudo-inverse."""
    try:
        if np.linalg.cond(a) < 1e12:
            return np.linalg.solve(a, b)
        return np.linalg.lstsq(a, b, rcond=1e-10)[0]
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b


def least(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-9) -> float:
    """Minimum of a unimodal function by golden section."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


class Profile:
    """e(rho) = e0 - rho e1 with the residuals of y and Wy on x; everything from moments, nothing per row."""

    def __init__(self, m: Moments, logdet: Callable[[float], float]):
        self.m, self.logdet = m, logdet
        self.b0, self.b1 = solved(m.xx, m.xy), solved(m.xx, m.xl)
        self.e00 = m.yy - float(m.xy @ self.b0)
        self.e01 = m.yl - float(m.xy @ self.b1)
        self.e11 = m.ll - float(m.xl @ self.b1)

    def sse(self, rho: float) -> float:
        return float(self.e00 - 2 * rho * self.e01 + rho * rho * self.e11)

    def value(self, rho: float) -> float:
        s2 = self.sse(rho) / self.m.n
        if not math.isfinite(s2) or s2 <= 0:
            return -math.inf
        return self.logdet(rho) - self.m.n / 2 * math.log(s2)


def fit(m: Moments, tr: list[float], model: str = "sar", predictors: list[str] | None = None, logdet: Callable[[float], float] | None = None, compat: str = "correct", bounds: tuple[float, float] = BOUNDS, simulate: int = 0, seed: int = 123) -> Fit:
    """The maximum of the profile likelihood over rho, with classical standard errors and impacts, all on the driver.

    tr: traces of the powers of W (also for the impacts). logdet: another log-determinant, such as the exact one.
    compat: "correct", or "reference" for SDM impacts whose second series has one power of rho too many.
    """
    profile = Profile(m, logdet or (lambda rho: tr_.logdet(rho, tr)))

    def negative(rho: float) -> float:
        v = profile.value(rho)
        return -v if math.isfinite(v) else 1e100

    rho = least(negative, *bounds)
    tr_.warn_if_truncated(rho)
    beta = profile.b0 - rho * profile.b1
    degenerate = not np.isfinite(beta).all()
    beta = np.where(np.isfinite(beta), beta, 0.0)
    s = profile.sse(rho)
    sigma2 = s / m.n
    vcov = sigma2 * solved(m.xx, np.eye(len(m.names)))
    se = np.sqrt(np.maximum(np.diag(vcov), 0.0))
    slope = -2 * profile.e01 + 2 * rho * profile.e11
    bend = -tr_.logdet_bend(rho, tr) - m.n / 2 * (2 * profile.e11 / s - (slope / s) ** 2) if s > 0 else math.nan
    se_rho = math.sqrt(-1 / bend) if bend < 0 else None
    loglik = profile.value(rho) - m.n / 2 * math.log(2 * math.pi) - m.n / 2
    k = len(m.names) + 2
    out = Fit(model, m.names, beta, rho, sigma2, vcov, se, se_rho, loglik, -2 * loglik + 2 * k, -2 * loglik + k * math.log(m.n), m.n, tr, m, degenerate)
    predictors = predictors or [x for x in m.names if x != "intercept" and not x.startswith("W_")]
    clock = time.perf_counter()
    out.impacts = impacts(out, predictors, compat, simulate, seed)
    out.seconds["impacts"] = time.perf_counter() - clock
    return out


def impacts(f: Fit, predictors: list[str], compat: str = "correct", simulate: int = 0, seed: int = 123) -> list[dict]:
    """Direct, indirect and total effects of each predictor; with ``simulate`` draws, for the SAR, also their standard
    errors from normal draws with the diagonal of the covariance."""
    at = {n: i for i, n in enumerate(f.names)}

    def effects(rho: float, b: float, theta: float) -> tuple[float, float, float]:
        direct = tr_.mean_diagonal(rho, f.traces, f.n) * b
        if theta:
            series = tr_.logdet_slope(rho, f.traces) if compat == "correct" else sum(rho**k * t for k, t in enumerate(f.traces[:-1], 1))
            direct += series / f.n * theta
        total = (b + theta) * tr_.mean_row_sum(rho)
        return float(direct), float(total - direct), float(total)

    out = []
    rng = np.random.default_rng(seed)
    for p in predictors:
        b, theta = f.beta[at[p]], f.beta[at[f"W_{p}"]] if f"W_{p}" in at else 0.0
        row = dict(zip(("variable", "direct", "indirect", "total"), (p, *effects(f.rho, b, theta)), strict=True))
        if simulate and f.model == "sar" and f.se_rho:
            rhos = np.clip(rng.normal(f.rho, f.se_rho, simulate), *BOUNDS)
            draws = np.array([effects(r, x, 0.0) for r, x in zip(rhos, rng.normal(b, f.se[at[p]], simulate))])
            for name, sd in zip(("direct", "indirect", "total"), draws.std(0, ddof=1)):
                z = row[name] / sd if sd > 0 else math.nan
                row |= {f"se_{name}": float(sd), f"z_{name}": float(z), f"p_{name}": shown_p(two_sided_p(z))}
        out.append(row)
    return out


def meat(rows: DataFrame, names: list[str], rho: float, beta: np.ndarray, extra: list[str] | None = None) -> np.ndarray:
    """sum e^2 v v' over the rows, v being [extra..., x...] and e the residuals at rho and beta; one aggregate."""
    e = F.col("y") - rho * F.col("wy")
    for n, b in zip(names, beta, strict=True):
        e = e - float(b) * F.col(n)
    columns = [*(extra or []), *names]
    got = rows.withColumn("_e2", e * e).agg(*[F.sum(F.col("_e2") * F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    return np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))], float)


def sandwich(f: Fit, rows: DataFrame, kind: str = "HC1") -> np.ndarray:
    """Robust covariance of beta with rho held fixed."""
    if kind not in ("HC0", "HC1"):
        raise ValueError(f"HC0 or HC1, not {kind}")
    bread = solved(f.moments.xx, np.eye(len(f.names)))
    v = bread @ meat(rows, f.names, f.rho, f.beta) @ bread
    if kind == "HC1":
        v = v * f.n / (f.n - len(f.names))
    f.robust[kind] = np.sqrt(np.maximum(np.diag(v), 0.0))
    return v


def full_sandwich(f: Fit, rows: DataFrame, kind: str = "HC1") -> np.ndarray:
    """Robust covariance of (rho, beta): the inverse Hessian of the concentrated likelihood around the products of the
    scores. The Hessian needs moments only; the scores one pass over the rows."""
    m, n, q = f.moments, f.n, len(f.names) + 1
    vv = np.empty((q, q))
    vv[0, 0], vv[0, 1:], vv[1:, 0], vv[1:, 1:] = m.ll, m.xl, m.xl, m.xx
    vy = np.concatenate([[m.yl], m.xy])
    theta = np.concatenate([[f.rho], f.beta])
    g = vy - vv @ theta  # V'e
    s = m.yy - 2 * theta @ vy + theta @ vv @ theta
    hessian = -n * vv / s + 2 * n * np.outer(g, g) / s**2
    hessian[0, 0] -= tr_.logdet_bend(f.rho, f.traces)
    s2 = s / n
    shift = -tr_.logdet_slope(f.rho, f.traces) / n
    e = F.col("y") - f.rho * F.col("wy")
    for name, b in zip(f.names, f.beta, strict=True):
        e = e - float(b) * F.col(name)
    scored = rows.select((F.col("wy") * e / s2 + shift).alias("g0"), *[(F.col(x) * e / s2).alias(f"g{i}") for i, x in enumerate(f.names, 1)])
    got = scored.agg(*products([f"g{i}" for i in range(q)])).first()
    b = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(q)] for i in range(q)], float)
    if kind == "HC1":
        b = b * n / (n - q)
    bread = solved(-hessian, np.eye(q))
    v = bread @ b @ bread
    v = (v + v.T) / 2
    se = np.sqrt(np.maximum(np.diag(v), 0.0))
    f.robust[f"full_{kind}"] = np.concatenate([se[1:], se[:1]])
    return v


def coefficients(f: Fit, spark: SparkSession, robust: str = "HC1") -> DataFrame:
    """The coefficient table; rho is the last row, with robust errors only from the full sandwich. Columns of the block
    subsampling are there if it was run. p-values are text for display."""
    hc = f.robust.get(robust)
    sbs = f.blocks.get("se")
    rows = []
    for i, term in enumerate([*f.names, "rho"]):
        est = float(f.beta[i]) if term != "rho" else f.rho
        mle = float(f.se[i]) if term != "rho" else f.se_rho
        row = [term, est, *_ratio(est, mle), *_ratio(est, float(hc[i]) if hc is not None and i < len(hc) else None)]
        if sbs is not None:
            row += [f.blocks["mean"][i], est - f.blocks["mean"][i], *_ratio(est, sbs[i])]
        rows.append(tuple(row))
    schema = "term string, estimate double, se_mle double, z_mle double, p_mle string, se_hc1 double, z_hc1 double, p_hc1 string"
    return spark.createDataFrame(rows, schema + (", mean_block double, delta_block double, se_sbs double, z_sbs double, p_sbs string" if sbs is not None else ""))


def _ratio(est: float, se: float | None) -> tuple[float | None, float | None, str | None]:
    if se is None or not math.isfinite(se) or se <= 0:
        return (se if se is not None and math.isfinite(se) else None, None, None)
    return se, est / se, shown_p(two_sided_p(est / se))


def impact_table(f: Fit, spark: SparkSession) -> DataFrame:
    if not f.impacts:
        raise ValueError("the fit has no impacts")
    more = [k for k in f.impacts[0] if k not in ("variable", "direct", "indirect", "total")]
    schema = "variable string, direct double, indirect double, total double" + "".join(f", {k} {'string' if k.startswith('p_') else 'double'}" for k in more)
    return spark.createDataFrame([tuple(r[k] for k in ("variable", "direct", "indirect", "total", *more)) for r in f.impacts], schema)


def fit_table(fits: list[Fit], spark: SparkSession) -> DataFrame:
    rows = [(f.model.upper(), f.n, f.loglik, f.aic, f.bic, f.seconds.get("estimation"), f.seconds.get("impacts"), sum(v for k, v in f.seconds.items() if k in ("estimation", "impacts")) or None, f.seconds.get("sbs")) for f in fits]
    return spark.createDataFrame(rows, "model string, n long, logLik double, AIC double, BIC double, elapsed_estimation_sec double, elapsed_impacts_sec double, elapsed_total_modeling_sec double, elapsed_sbs_sec double")


def trend(rows: DataFrame, f: Fit) -> DataFrame:
    """(cell, trend, residual): x beta without the lag of y, and what is left once that lag is taken off too."""
    x = F.lit(0.0)
    for n, b in zip(f.names, f.beta, strict=True):
        x = x + float(b) * F.col(n)
    return rows.select("cell", x.alias("trend"), (F.col("y") - f.rho * F.col("wy") - x).alias("residual"))


def summary(f: Fit, digits: int = 4) -> str:
    lines = [f"{f.model.upper()}  n = {f.n}  rho = {round(f.rho, digits)}  sigma2 = {round(f.sigma2, 6)}  logLik = {round(f.loglik, digits)}  AIC = {round(f.aic, digits)}  BIC = {round(f.bic, digits)}"]
    for n, b, s in zip(f.names, f.beta, f.se, strict=True):
        se, z, p = _ratio(float(b), float(s))
        lines.append(f"  {n:<16}{b:>14.6f}{se or 0:>14.6f}{z or 0:>10.{digits}f}  {p or ''}")
    return "\n".join(lines)
