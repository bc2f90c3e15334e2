"""Toy lattices with answers by hand, properties, and dense NumPy as a second opinion."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.graph import scenarios, search
from gridloom.graph.components import components
from gridloom.operators import autocorr, blocks, models, support, traces, weights
from gridloom.plans import benchmark, regression
from gridloom.sources import cells as src
from gridloom.sources import sinks
from gridloom.sources.cells import Grid


def lattice(spark, rows, cols, keep=None):
    g = Grid(rows, cols)
    t = src.template(spark, g)
    return (t.where(F.col("cell").isin(keep)) if keep else t), g


def pairs(edge):
    return sorted((r["i"], r["j"]) for r in edge.select("i", "j").collect())


@pytest.mark.parametrize("rows,cols,kind,nnz", [(3, 3, "queen", 40), (3, 3, "rook", 24), (1, 4, "queen", 6), (1, 4, "rook", 6), (4, 5, "queen", 8 * 20 - 24 - 30 + 4), (4, 5, "rook", 80 - 8 - 10)])
def test_full_lattices_by_all_routes(spark, rows, cols, kind, nnz):
    cells, g = lattice(spark, rows, cols)
    a = pairs(weights.edges(cells, g, kind))
    assert len(a) == nnz and a == pairs(weights.edges_by_projection(cells, g, cells, kind)) == pairs(weights.edges_by_scan(cells, g, kind, 3))
    assert set(a) == {(j, i) for i, j in a}


def test_no_wrap_around_and_isolates(spark):
    cells, g = lattice(spark, 2, 3)
    assert (3, 4) not in pairs(weights.edges(cells, g))
    for keep, kind, edges, alone in (([1, 9], "queen", 0, 2), ([1, 5, 9], "queen", 4, 0), ([1, 5, 9], "rook", 0, 3), ([1, 2, 9], "queen", 2, 1)):
        cells, g = lattice(spark, 3, 3, keep)
        e = weights.edges(cells, g, kind)
        assert e.count() == edges and weights.isolates(cells, e).count() == alone
    with pytest.raises(ValueError):
        weights.standardised_or_error(weights.no_edges(spark))
    with pytest.raises(ValueError):
        weights.steps("bishop")


def test_visiting_order_of_steps(spark):
    cells, g = lattice(spark, 3, 3)
    got = {(r["o"], r["j"]) for r in weights.edges(cells, g, ranked=True).where("i = 5").collect()}
    assert got == {(0, 2), (1, 8), (2, 4), (3, 6), (4, 1), (5, 3), (6, 7), (7, 9)}


def test_traces_logdet_and_solve(spark):
    cells, g = lattice(spark, 3, 3)
    w = weights.row_standardised(weights.edges(cells, g))
    assert [round(r["tr"], 10) for r in traces.exact_traces(w).orderBy("k").collect()] == [0.0, 1.92, 0.84]
    m = traces.dense(w, cells)
    assert np.allclose(m.sum(1), 1)
    assert traces.exact_logdet(0.5, m) == pytest.approx(-0.3035254368724325)
    assert traces.logdet(0.5, traces.power_traces(m, 60)) == pytest.approx(-0.3035254368724325, abs=1e-9)
    values = cells.select("cell", F.col("cell").cast("double").alias("b"))
    got = {r["cell"]: r["x"] for r in weights.solve(w, values, 0.5, "b", 50).collect()}
    want = np.linalg.solve(np.eye(9) - 0.5 * m, np.arange(1.0, 10))
    assert np.allclose([got[c] for c in range(1, 10)], want)
    with pytest.raises(ValueError):
        traces.dense(w, cells, most=3)
    with pytest.raises(ValueError):
        weights.solve(w, values, 1.0, "b")


def test_random_traces_match_numpy_on_the_same_signs(spark):
    cells, g = lattice(spark, 5, 6)
    w = weights.row_standardised(weights.edges(cells, g))
    m = traces.dense(w, cells)
    v = np.array([[r["a"], r["b"]] for r in cells.orderBy("cell").select(scalars.signs(F.col("cell"), 0, 7).alias("a"), scalars.signs(F.col("cell"), 1, 7).alias("b")).collect()])
    want, z = [], v
    for _ in range(4):
        z = m @ z
        want.append((v * z).sum() / 2)
    assert traces.traces(w, cells, 4, 2, 7) == pytest.approx(want)
    assert traces.traces(w, cells, 2, 2, 7, exact_low_order=True)[0] == 0


def test_compare(spark):
    a = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "i long, j long, w double")
    one_off = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0 + 1e-9)], "i long, j long, w double")
    assert weights.compare(a, a).first()["equal_within_tol"] and weights.compare(a, a).first()["structure_equal"]
    r = weights.compare(a, one_off).first()
    assert not r["equal_within_tol"] and r["structure_equal"] and r["diff_nnz"] == 1
    r = weights.compare(a, a.where("i = 1")).first()
    assert not r["structure_equal"] and not r["nnz_equal"]
    assert weights.compare(weights.no_edges(spark), weights.no_edges(spark)).first()["equal_within_tol"]


def test_support_treats_null_and_nan_alike(spark):
    rows = [(1, 1, 1, 1.0, 0.0, -1.0, 2.0), (2, 1, 2, None, 1.0, 1.0, 1.0), (3, 1, 3, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cell long, row long, col long, gdp double, pop double, ndvi double, mndwi double")
    assert [r["cell"] for r in support.common_support(df).collect()] == [1]
    with pytest.raises(ValueError):
        support.common_support(df.where("cell > 1"), check=True)
    assert [r["cell"] for r in support.checked_cells(spark.createDataFrame([(3,), (1,), (3,)], "cell long"), 4).collect()] == [1, 3]
    for bad in ([(0,)], [(5,)]):
        with pytest.raises(ValueError):
            support.checked_cells(spark.createDataFrame(bad, "cell long"), 4)


def test_components_chain_star_and_edge_cases(spark):
    n = 300
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(200)) and len(got) == n + 201
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(5, 5)], "u long, v long")).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_against_union_find(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_orders_in_one_task_and_over_levels_agree(spark, sf):
    cells, g = src.fixture_grid(spark, sf)
    base = support.common_support(cells).where("row <= 8")
    parts = scenarios.labelled(base, g)
    ranked = weights.edges(base, g, ranked=True).join(parts.select("component", F.col("cell").alias("i")), "i").select("component", "i", "o", "j")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    starts = scenarios.seeds(parts)
    one = sorted(map(tuple, search.orders(ranked, starts, sizes).collect()))
    two = sorted(map(tuple, search.orders(ranked, starts, sizes, bound=1).collect()))
    assert one == two and len(one) == base.count()


def counted(spark, name, work):
    """What work() gives, and the number of its jobs."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("window", [1, 1_000])
def test_orders_by_windows_are_those_of_one_task(spark, window):
    """Levels over the cluster (a window is too large), and some windows; without a job for each level."""
    from gridloom.runtime import cut

    cells, g = lattice(spark, *((5, 8) if window == 1 else (200, 12)))
    base = cut(cells.where("pmod(xxhash64(cell), 10) < 6"), "support")
    parts = cut(scenarios.labelled(base, g), "labelled")
    ranked = cut(weights.edges(base, g, ranked=True).join(parts.select("component", F.col("cell").alias("i")), "i").select("component", "i", "o", "j"), "ranked")
    sizes, starts = cut(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes"), cut(scenarios.seeds(parts), "seeds")
    want = sorted(map(tuple, search.orders(ranked, starts, sizes).collect()))
    got, jobs = counted(spark, f"windows-{window}", lambda: sorted(map(tuple, search.orders(ranked, starts, sizes, 10, g, window).collect())))
    assert got == want and len(got) == base.count() and sizes.where("n > 10").count()
    assert jobs < 100


def test_spatial_supports_of_large_components_take_few_jobs(spark):
    cells, g = lattice(spark, 120, 4)
    (want, _), (got, jobs) = (counted(spark, f"supports-{bound}", lambda b=bound: sorted(map(tuple, scenarios.spatial_supports(cells, g, [0.1, 0.5], bound=b).collect()))) for bound in (250_000, 10))
    assert got == want and len(got) == 48 + 240
    assert jobs < 120  # 60 levels


def test_allocation_labels_and_proportions(spark):
    sizes = spark.createDataFrame([(1, 39), (2, 14), (3, 6)], "component long, n long")
    take = lambda k: [r["take"] for r in scenarios.allocate(sizes, k, 59).orderBy("component").collect()]
    assert take(14) == [9, 3, 2] and take(15) == [10, 4, 1]
    assert scalars.proportions([0.5, 1]) == [0.5, 1] and scalars.proportions([50, 100]) == [0.5, 1]
    for bad in ([1, 50], [0], []):
        with pytest.raises(ValueError):
            scalars.proportions(bad)
    assert [scalars.share_label(s) for s in (0.0001, 0.005, 0.1, 1)] == ["0p01pct", "0p5pct", "10pct", "100pct"]


def test_scenarios_are_nested_and_sized(spark, sf):
    cells, g = src.fixture_grid(spark, sf)
    base = support.common_support(cells)
    for mode in ("random", "spatial"):
        found, sizes = scenarios.prepare(base, g, [0.1, 1.0], mode)
        by = {r["scenario"]: r["n_cells"] for r in sizes.collect()}
        assert by == {"10pct": 86, "100pct": 863}
        assert found.where("scenario = '10pct'").join(found.where("scenario = '100pct'").select("cell"), "cell", "left_anti").isEmpty()
    with pytest.raises(ValueError):
        scenarios.prepare(base, g, [0.1], "odd")
    with pytest.raises(ValueError):
        scenarios.prepare(base.limit(0), g, [0.1])


def test_merge_resample_and_masks(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "cell long, value double")
    b = spark.createDataFrame([(1, 9.0), (2, 8.0), (4, 7.0)], "cell long, value double")
    assert {r["cell"]: r["value"] for r in src.merge_layers([a, b]).collect()} == {1: 1.0, 2: 8.0, 4: 7.0}
    t, g = lattice(spark, 4, 4)
    coarse = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)], "cell long, value double")
    got = {r["cell"]: r["value"] for r in src.resample_nearest(t, g, coarse, Grid(2, 2, dx=2.0, dy=2.0)).collect()}
    assert [got[c] for c in (1, 2, 3, 4, 5, 9, 11, 16)] == [1, 1, 2, 2, 1, 3, 4, 4]
    provinces = spark.createDataFrame([(1, "p"), (2, "q")], "cell long, province string")
    good = spark.createDataFrame([("a", "p"), ("b", "q")], "region string, province string")
    assert src.region_masks(provinces, good).count() == 4
    with pytest.raises(ValueError, match="b: z"):
        src.region_masks(provinces, spark.createDataFrame([("a", "p"), ("b", "z")], "region string, province string"))
    with pytest.raises(ValueError):
        src.layer(spark.createDataFrame([(17, 1.0)], "cell long, value double"), g)
    with pytest.raises(ValueError, match="gdp_2020"):
        src.pick_layer(spark.createDataFrame([("gdp_2020", 1, 1.0)], "layer string, cell long, value double"), "gdp_1999")
    with pytest.raises(ValueError):
        src.Config().checked()
    with pytest.raises(LookupError):
        src.loaded_inputs(spark, ["not_there_1", "not_there_2"])


def test_region_inputs_and_the_nation(spark, tmp_path):
    for name, values in {"pop_2020_": {1: 1.0, 2: 2.0}, "ndvi_2020_x": {1: 0.1}, "mndwi_2020_x": {2: 0.2}}.items():
        spark.createDataFrame(list(values.items()), "cell long, value double").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([("gdp_2020", 1, 5.0), ("gdp_2020", 3, 6.0)], "layer string, cell long, value double").write.parquet(str(tmp_path / "gdp_2020_.parquet"))
    config = src.Config(layer_path=str(tmp_path) + "/{name}_{year}_{tag}.parquet", regions=["r"], region_tags={"r": "x"})
    masks = spark.createDataFrame([("r", 1), ("r", 2)], "region string, cell long")
    got = {(r["region"], r["cell"]): (r["gdp"], r["pop"], r["ndvi"], r["mndwi"]) for r in src.all_regions(spark, config, masks, view="inputs").collect()}
    assert got[("r", 1)] == (5.0, 1.0, 0.1, None) and got[("nation", 2)] == (None, 2.0, None, 0.2) and ("r", 3) not in got
    assert src.loaded_inputs(spark, ["nope", "inputs"]).count() == 4
    with pytest.raises(ValueError):
        src.region_inputs(spark, config, "nation", masks)


def dense_moran(x, w):
    z, n = x - x.mean(), len(x)
    return n / w.sum() * (z @ w @ z) / (z @ z), (n - 1) / (2 * w.sum()) * (w * (x[:, None] - x[None, :]) ** 2).sum() / (z @ z)


def test_moran_and_geary_against_dense(spark):
    cells, g = lattice(spark, 6, 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=42) + np.arange(42) / 10
    df = cells.join(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "cell long, v double"), "cell").withColumn("region", F.lit("r"))
    long = autocorr.long_form(df, ["v"], ["region"])
    r = autocorr.moments(long, g, keys=["region"]).first()
    w = traces.dense(weights.row_standardised(weights.edges(cells, g)), cells)
    i, c = dense_moran(x, w)
    assert r["moran_i"] == pytest.approx(i) and r["geary_c"] == pytest.approx(c)
    assert r["s1"] == pytest.approx(((w + w.T) ** 2).sum() / 2) and r["s2"] == pytest.approx(((w.sum(0) + w.sum(1)) ** 2).sum())
    sims = [dense_moran(rng.permutation(x), w) for _ in range(3000)]
    assert r["moran_var"] == pytest.approx(np.var([s[0] for s in sims]), rel=0.12) and r["geary_var"] == pytest.approx(np.var([s[1] for s in sims]), rel=0.12)
    s = autocorr.summary(df, g, ["v"]).first()
    assert 0 <= s["moran_p"] < 0.05 and s["retained_non_isolates"] == 42


def test_autocorrelation_without_neighbours_gives_nulls(spark):
    cells, g = lattice(spark, 3, 3, [1, 9])
    s = autocorr.summary(cells.withColumns({"region": F.lit("r"), "v": F.lit(1.0)}), g, ["v"]).first()
    assert s["moran_I"] is None and s["retained_non_isolates"] == 0 and s["non_na"] == 2


def test_build_seconds_take_few_jobs_for_many_regions(spark):
    cells, g = lattice(spark, 40, 6)
    cells = cells.withColumns({"band": F.when(F.col("row") > 1, F.col("row") % 20), "v": F.when(F.col("cell") % 3 > 0, F.col("cell")).cast("double")})
    for bound in (1_000, 13):
        got, jobs = counted(spark, f"seconds-{bound}", lambda b=bound: autocorr.build_seconds(cells, g, ["v"], "queen", ["band"], b))
        assert set(got) == {(b, "v") for b in [None, *range(20)]} and all(a > 0 and b > 0 for a, b in got.values())
        assert len({a for a, _ in got.values()}) == 1 and jobs < 20
    cell = np.array(sorted(r["cell"] for r in cells.where("v IS NOT NULL").collect()))
    for kind in ("queen", "rook"):
        want = sorted(map(tuple, weights.row_standardised(weights.edges(cells.where("v IS NOT NULL"), g, kind)).select("i", "j", "w").collect()))
        assert sorted(zip(*(x.tolist() for x in autocorr.local_weights(cell, g, kind)))) == [pytest.approx(x) for x in want]


def simulated(spark, rows=26, cols=26, rho=0.5, theta=0.0, seed=5):
    cells, g = lattice(spark, rows, cols)
    edge = weights.row_standardised(weights.edges(cells, g))
    w = traces.dense(edge, cells)
    rng = np.random.default_rng(seed)
    n = rows * cols
    x = rng.normal(size=(n, 2))
    y = np.linalg.solve(np.eye(n) - rho * w, 1 + x @ [1.0, -0.5] + theta * (w @ x[:, 0]) + rng.normal(scale=0.5, size=n))
    data = spark.createDataFrame([(i + 1, float(y[i]), 1.0, float(x[i, 0]), float(x[i, 1])) for i in range(n)], "cell long, y double, intercept double, a double, b double")
    return data, edge, w, g, x, y


def test_sar_recovers_and_matches_dense_likelihood(spark):
    data, edge, w, g, x, y = simulated(spark)
    rows, names = models.model_rows(data, edge)
    tr = traces.power_traces(w, 60)
    f = models.fit(models.moments(rows, names), tr, "sar")
    assert f.rho == pytest.approx(0.5, abs=0.1) and f.beta == pytest.approx([1, 1, -0.5], abs=0.25)
    n, xx = len(y), np.column_stack([np.ones(len(y)), x])

    def loglik(rho):
        e = y - rho * w @ y
        e = e - xx @ np.linalg.lstsq(xx, e, rcond=None)[0]
        return traces.exact_logdet(rho, w) - n / 2 * math.log(e @ e / n) - n / 2 * math.log(2 * math.pi) - n / 2

    grid = np.linspace(-0.9, 0.9, 361)
    assert f.rho == pytest.approx(grid[np.argmax([loglik(r) for r in grid])], abs=0.006) and f.loglik == pytest.approx(loglik(f.rho), abs=1e-4)
    h = 1e-4
    second = (loglik(f.rho + h) - 2 * loglik(f.rho) + loglik(f.rho - h)) / h**2
    assert f.se_rho == pytest.approx(math.sqrt(-1 / second), rel=1e-2)
    s = np.linalg.inv(np.eye(n) - f.rho * w)
    direct = np.trace(s) / n * f.beta[1]
    assert f.impacts[0]["direct"] == pytest.approx(direct, rel=1e-4) and f.impacts[0]["total"] == pytest.approx(s.sum() / n * f.beta[1], rel=1e-6)
    e = y - f.rho * w @ y - xx @ f.beta
    bread = np.linalg.inv(xx.T @ xx)
    hc = bread @ (xx.T * e**2) @ xx @ bread
    assert models.sandwich(f, rows, "HC0") == pytest.approx(hc) and models.sandwich(f, rows) == pytest.approx(hc * n / (n - 3))

    def full(t):
        r = y - t[0] * w @ y - xx @ t[1:]
        return traces.logdet(t[0], tr) - n / 2 * math.log(r @ r / n)

    t0, k = np.concatenate([[f.rho], f.beta]), 4
    step, hess = 1e-4 * np.eye(k), np.empty((k, k))
    for i in range(k):
        for j in range(k):
            hess[i, j] = (full(t0 + step[i] + step[j]) - full(t0 + step[i] - step[j]) - full(t0 - step[i] + step[j]) + full(t0 - step[i] - step[j])) / 4e-8
    s2 = e @ e / n
    scores = np.column_stack([(w @ y) * e / s2 - traces.logdet_slope(f.rho, tr) / n, xx * e[:, None] / s2])
    a = np.linalg.inv(-hess)
    want = a @ (scores.T @ scores * n / (n - k)) @ a
    assert models.full_sandwich(f, rows) == pytest.approx(want, rel=2e-2, abs=1e-6)
    table = models.coefficients(f, spark, "full_HC1").collect()
    assert [r["term"] for r in table] == ["intercept", "a", "b", "rho"] and table[-1]["se_hc1"] is not None
    assert "rho" in models.summary(f) and models.trend(rows, f).count() == n
    simulated_se = models.fit(f.moments, tr, "sar", simulate=200).impacts[0]
    assert simulated_se["se_total"] > 0 and simulated_se["p_total"]


def test_sdm_impacts_in_both_settings(spark):
    data, edge, w, g, x, y = simulated(spark, theta=0.7)
    rows, names = models.model_rows(data, edge, "sdm")
    tr = traces.power_traces(w, 80)
    m = models.moments(rows, names)
    f = models.fit(m, tr, "sdm")
    at = {n: i for i, n in enumerate(names)}
    s = np.linalg.inv(np.eye(len(y)) - f.rho * w)
    b, t = f.beta[at["a"]], f.beta[at["W_a"]]
    assert t == pytest.approx(0.7, abs=0.3)
    assert f.impacts[0]["direct"] == pytest.approx(np.trace(s @ (b * np.eye(len(y)) + t * w)) / len(y), rel=1e-4)
    other = models.fit(m, tr, "sdm", compat="reference").impacts[0]
    assert other["direct"] == pytest.approx(np.trace(s) / len(y) * b + f.rho * np.trace(s @ w) / len(y) * t, rel=1e-3) and other["total"] == pytest.approx(f.impacts[0]["total"])


def test_collinear_columns_still_fit(spark):
    data, edge, w, *_ = simulated(spark, 8, 8)
    data = data.withColumn("c", F.col("a"))
    rows, names = models.model_rows(data, edge)
    f = models.fit(models.moments(rows, names), traces.power_traces(w, 30))
    assert np.isfinite(f.beta).all() and np.isfinite(f.loglik)


def test_blocks_are_connected_and_bounded(spark):
    data, edge, w, g, *_ = simulated(spark, 14, 14)
    placed = data.withColumns({"row": scalars.row_of(F.col("cell"), 14), "col": scalars.col_of(F.col("cell"), 14)})
    got = blocks.draws(placed, edge, g, "sar", k=4, m=40, kmax=10, probes=10)
    assert [r["size"] for r in got.collect()] == [40] * 4
    s = blocks.scaled(got, 196)
    assert len(s["se"]) == 4 and s["size"] == 40
    assert blocks.scaled(got.limit(0), 196)["se"] == []


def test_failures_and_timing(spark):
    ok = benchmark.timed(spark, lambda: spark.range(3).count())
    assert ok.ok and ok.value == 3
    bad = benchmark.timed(spark, lambda: 1 / 0)
    assert not bad.ok and "ZeroDivision" in bad.error
    assert benchmark.failed("m", "build", "cannot allocate", [], 1)["failure_class"] == "hard" and benchmark.failed("m", "build", "what", [], 1)["failure_class"] == "soft"
    assert scalars.critical(["Result may be LARGE"], ["large"]) and not scalars.critical([], ["x"])
    assert scalars.two_sided_p(1.959964) == pytest.approx(0.05, abs=1e-6) and scalars.shown_p(1e-20) == "<1e-16" and scalars.two_sided_p(None) is None


def test_benchmark_routes_agree(spark, sf, tmp_path):
    cells, g = src.fixture_grid(spark, sf)
    base = support.common_support(cells)
    got = benchmark.run_benchmark(scenarios.random_supports(base, [0.3]), base, g, reps=1, out_dir=str(tmp_path))
    assert got["raw"].where("status <> 'ok'").count() == 0
    assert got["validation_summary"].where("NOT all_output_equivalence_ok").count() == 0
    assert {r["method"] for r in got["gain"].collect()} == {"support_edges", "full_scan"}
    assert (tmp_path / "final" / "summary").exists() and (tmp_path / "progress" / "raw").exists() and (tmp_path / "final" / "gain_csv").exists()


def test_suite_and_sinks(spark, sf, tmp_path):
    cells, g = src.fixture_grid(spark, sf)
    suite = regression.run_suite({"fixture": (cells, g)}, str(tmp_path), kmax=6, probes=4, k=2, m=40, hc="both", block_draws=True)
    assert suite["model_fit_summary"].count() == 2 and suite["support_summary"].columns[0] == "region" and suite["timing_note"].count() == 7
    assert all(r["elapsed_impacts_sec"] > 0 and r["elapsed_total_modeling_sec"] == r["elapsed_estimation_sec"] + r["elapsed_impacts_sec"] for r in suite["model_fit_summary"].collect())
    assert {p.name for p in (tmp_path / "fixture").iterdir()} >= {"sar_coefficients", "sdm_coefficients_full_hc1", "sbs_draws_sar", "meta"}
    assert "se_sbs" in spark.read.parquet(str(tmp_path / "fixture" / "sar_coefficients")).columns
    assert regression.run_autocorrelation(cells, g, str(tmp_path / "auto"), key="band", save_edges=True).count() == 4
    assert (tmp_path / "auto" / "weights").exists() and sinks.write_sheets({"x": cells}, None) == []
    assert src.cached_support(spark, str(tmp_path / "s"), lambda: support.common_support(cells)).count() == src.cached_support(spark, str(tmp_path / "s"), None or (lambda: 1 / 0)).count() == 863
    with pytest.raises(ValueError):
        src.read_support(spark, str(tmp_path / "auto" / "autocorr_summary"))
    exact = regression.run_region(cells.where("band = 0"), g, "exact", logdet="exact", kmax=30)
    assert exact.fits["sar"].n == 858 and regression.run_dimensions(cells, key="band").count() == 1


def test_exact_logdet_by_lines(spark):
    """Beyond the cells of a full matrix, against the full matrix."""
    import numpy as np

    for rows, cols in ((70, 60), (5, 40), (1, 1)):
        g = src.Grid(rows, cols)
        cells = src.template(spark, g).where("(cell * 7919) % 13 < 10 OR cell = 1")
        edge = weights.row_standardised(weights.edges(cells, g))
        lines = traces.Lines(edge, cells)
        w = traces.dense(edge, cells, 10_000)
        assert lines.n == len(w)
        for rho in (-0.7, 0.0, 0.5, 0.95):
            assert lines.logdet(rho) == pytest.approx(traces.exact_logdet(rho, w), abs=1e-8)
    with pytest.raises(ValueError):
        traces.Lines(edge, src.template(spark, src.Grid(9, 9)), most=8)


def test_bilinear_against_plain_arithmetic(spark):
    import math

    fine, coarse = src.Grid(7, 9, 0.3, -0.2, 0.5, 0.7), src.Grid(4, 5, 0.0, 0.0, 1.0, 1.0)
    values = {c: float(c * c % 17) for c in range(1, 21) if c not in (3, 12)}
    source = spark.createDataFrame([*values.items(), (3, None), (12, float("nan"))], "cell long, value double")
    got = {r["cell"]: r["value"] for r in src.resample_bilinear(src.template(spark, fine), fine, source, coarse).collect()}
    for r in range(1, 8):
        for c in range(1, 10):
            u, v = 0.3 + (c - 0.5) * 0.5 - 0.5, -0.2 + (r - 0.5) * 0.7 - 0.5
            total = weight = 0.0
            for a in (0, 1):
                for b in (0, 1):
                    rr, cc = math.floor(v) + 1 + a, math.floor(u) + 1 + b
                    w = (v - math.floor(v) if a else 1 - v + math.floor(v)) * (u - math.floor(u) if b else 1 - u + math.floor(u))
                    if 1 <= rr <= 4 and 1 <= cc <= 5 and (rr - 1) * 5 + cc in values:
                        total, weight = total + w * values[(rr - 1) * 5 + cc], weight + w
            assert got[(r - 1) * 9 + c] == (pytest.approx(total / weight) if weight > 0 else None)
    template = src.template(spark, fine)
    both = support.align({"a": source, "b": source}, template, fine, {"a": coarse, "b": coarse}, {"b": "bilinear"}).collect()
    assert {r["cell"]: r["b"] for r in both} == got and any(r["a"] != r["b"] for r in both)


def test_polygons_against_point_tests(spark):
    g = src.Grid(30, 40, 10.0, 50.0, 0.25, -0.5)
    shapes = {
        "star": [[(11, 49), (15, 36.2), (19, 49.5), (10.5, 41), (19.6, 41.3), (11, 49)]],
        "ring": [[(10, 50), (20, 50), (20, 35), (10, 35), (10, 50)], [(12, 47), (12, 40), (18, 40), (18, 47), (12, 47)]],
        "outside": [[(-5, 48), (13, 60), (13, 30), (-5, 48)]], "tiny": [[(10.1, 49.9), (10.11, 49.9), (10.11, 49.89), (10.1, 49.9)]],
    }
    texts = [(n, f"{'MULTI' * (n == 'ring')}POLYGON ((" + "), (".join(", ".join(f"{x} {y}" for x, y in ring) for ring in rings) + "))") for n, rings in shapes.items()] + [("none", None), ("empty", "POLYGON EMPTY")]
    got = {(r["name"], r["cell"]) for r in src.polygon_cells(spark.createDataFrame(texts, "name string, wkt string"), g).collect()}
    want = set()
    for n, rings in shapes.items():
        for row in range(1, 31):
            for col in range(1, 41):
                x, y = 10 + (col - 0.5) * 0.25, 50 - (row - 0.5) * 0.5
                odd = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:])) % 2
                want |= {(n, (row - 1) * 40 + col)} if odd else set()
    assert got == want and len(want) > 500


def test_standardisation_drops_rows_without_a_sum_and_their_columns(spark):
    edge = spark.createDataFrame([(1, 2, 1.0), (1, 3, 3.0), (1, 4, 2.0), (2, 1, 2.0), (3, 1, 0.0), (4, 2, 1.0), (4, 2, -1.0)], "i long, j long, w double")
    got = sorted(map(tuple, weights.row_standardised(edge).collect()))
    assert got == [(1, 2, 1.0), (2, 1, 1.0)]
    assert weights.standardised_or_error(edge, symmetric=False).count() == 2
    with pytest.raises(ValueError):
        weights.standardised_or_error(spark.createDataFrame([(1, 2, 1.0)], edge.schema), symmetric=False)


def test_levels_keep_what_was_seen_in_few_tables(spark):
    g = src.Grid(1, 40)
    cells = src.template(spark, g)
    got = {r["cell"]: r["level"] for r in search.levels(weights.edges(cells, g), spark.createDataFrame([(3,)], "cell long")).collect()}
    assert got == {c: abs(c - 3) for c in range(1, 41)}


def test_golden_counts(spark, sf):
    cells, g = src.fixture_grid(spark, sf)
    base = support.common_support(cells)
    for kind, nnz, alone, parts, largest in (("queen", 3786, 5, 8, 854), ("rook", 1912, 38, 71, 182)):
        e = weights.edges(base, g, kind)
        sizes = [r["count"] for r in scenarios.labelled(base, g, kind).groupBy("component").count().collect()]
        assert (e.count(), weights.isolates(base, e).count(), len(sizes), max(sizes)) == (nnz, alone, parts, largest)


def test_labels_and_seeds_against_a_plain_search(spark, sf):
    cells, g = src.fixture_grid(spark, sf)
    base = support.common_support(cells)
    known = {(r["row"], r["col"]): r["cell"] for r in base.collect()}
    left, want, seeds = dict(known), {}, {}
    for number in range(1, len(known) + 1):
        if not left:
            break
        start = min(left, key=left.get)
        part, todo = [], [start]
        del left[start]
        while todo:
            r, c = todo.pop()
            part.append((r, c))
            for dr, dc in weights.ROOK:
                if (r + dr, c + dc) in left:
                    del left[r + dr, c + dc]
                    todo.append((r + dr, c + dc))
        want |= {known[x]: number for x in part}
        mr, mc = sum(r for r, _ in part) / len(part), sum(c for _, c in part) / len(part)
        seeds[number] = min((round((r - mr) ** 2 + (c - mc) ** 2, 9), known[r, c]) for r, c in part)[1]
    parts = scenarios.labelled(base, g, "rook")
    assert {r["cell"]: r["component"] for r in parts.collect()} == want
    assert {r["component"]: r["cell"] for r in scenarios.seeds(parts).collect()} == seeds


def test_entry_and_oracles_have_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
