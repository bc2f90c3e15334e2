"""Named queries over the fixture grid, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.graph import scenarios, search
from gridloom.operators import autocorr, blocks, models, support, traces, weights
from gridloom.plans import benchmark, fit_sql, regression
from gridloom.runtime import cut
from gridloom.sources import cells as src
from gridloom.sources.cells import LAYERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The fixture grid and its support in SQL, for all that follow.
GRID = """
sums AS (SELECT l_orderkey + 1 AS cell, sum(l_quantity) AS pop, avg(CASE WHEN l_returnflag <> 'N' THEN l_discount END) AS mndwi FROM lineitem GROUP BY 1),
grid AS (SELECT o_orderkey + 1 AS cell, o_orderkey // 100 + 1 AS row, o_orderkey % 100 + 1 AS col, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS gdp, pop,
                CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS ndvi, mndwi, o_orderkey // 100 // 30 AS band, n_name AS province, r_name AS region_name
         FROM orders LEFT JOIN sums ON sums.cell = o_orderkey + 1 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
support AS (SELECT * FROM grid WHERE gdp IS NOT NULL AND pop IS NOT NULL AND ndvi IS NOT NULL AND mndwi IS NOT NULL)"""
MOVES = {"queen": "(-1,0),(1,0),(0,-1),(0,1),(-1,-1),(-1,1),(1,-1),(1,1)", "rook": "(-1,0),(1,0),(0,-1),(0,1)"}


def pairs_sql(contiguity: str = "queen") -> str:
    return f"""
moves AS (SELECT * FROM (VALUES {MOVES[contiguity]}) AS t(dr, dc)),
pairs AS (SELECT a.cell AS i, b.cell AS j FROM support a CROSS JOIN moves JOIN support b ON b.row = a.row + dr AND b.col = a.col + dc)"""


DEGREE = "deg AS (SELECT i AS cell, count(*) AS d FROM pairs GROUP BY i), w AS (SELECT i, j, 1.0 / d AS w FROM pairs JOIN deg ON deg.cell = i)"
KEPT = "kept AS (SELECT support.*, d FROM support JOIN deg USING (cell))"
SAMPLE = """
stats AS (SELECT avg(pop) AS mp, stddev_samp(pop) AS sp, avg(ndvi) AS mn, stddev_samp(ndvi) AS sn, avg(mndwi) AS mm, stddev_samp(mndwi) AS sm FROM kept),
sample AS (SELECT cell, ln(1 + gdp) AS y, 1.0 AS intercept, (pop - mp) / sp AS pop, (ndvi - mn) / sn AS ndvi, (mndwi - mm) / sm AS mndwi FROM kept CROSS JOIN stats),
lagged AS (SELECT w.i AS cell, sum(w * y) AS wy, sum(w * pop) AS w_pop, sum(w * ndvi) AS w_ndvi, sum(w * mndwi) AS w_mndwi FROM w JOIN sample ON sample.cell = w.j GROUP BY w.i),
model AS (SELECT sample.*, wy, w_pop, w_ndvi, w_mndwi FROM sample JOIN lagged USING (cell))"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _support(spark: SparkSession, d: str):
    cells, grid = src.fixture_grid(spark, d)
    return support.common_support(cells), grid


def _weights(spark: SparkSession, d: str, contiguity: str = "queen"):
    base, grid = _support(spark, d)
    base = cut(base, "support")
    edge = cut(weights.edges(base, grid, contiguity), "edges")
    return base, grid, edge


def _sample(spark: SparkSession, d: str):
    base, grid, edge = _weights(spark, d)
    w = cut(weights.row_standardised(edge, symmetric=True), "weights")
    return cut(support.design(weights.retained(base, edge)), "design"), w, grid


# Layers and support


@query("grid_layers", f"WITH {GRID} SELECT cell, row, col, round(gdp, 4) AS gdp, round(pop, 4) AS pop, round(ndvi, 4) AS ndvi, round(mndwi, 6) AS mndwi FROM grid")
def grid_layers(spark, d):
    g, _ = src.fixture_grid(spark, d)
    return g.select("cell", "row", "col", *[F.round(n, 6 if n == "mndwi" else 4).alias(n) for n in LAYERS])


@query("common_support", f"WITH {GRID} SELECT cell, row, col, round(gdp, 4) AS gdp, round(pop, 4) AS pop, round(ndvi, 4) AS ndvi, round(mndwi, 6) AS mndwi FROM support")
def common_support(spark, d):
    s, _ = _support(spark, d)
    return s.select("cell", "row", "col", *[F.round(n, 6 if n == "mndwi" else 4).alias(n) for n in LAYERS])


@query(
    "dimension_table",
    f"""WITH {GRID} SELECT band, max(row) - min(row) + 1 AS "rows", max(col) - min(col) + 1 AS cols, (max(row) - min(row) + 1) * (max(col) - min(col) + 1) AS total_grids, count(gdp) AS non_na_gdp, count(pop) AS non_na_pop,
    count(ndvi) AS non_na_ndvi, count(mndwi) AS non_na_mndwi, count(CASE WHEN gdp IS NOT NULL AND pop IS NOT NULL AND ndvi IS NOT NULL AND mndwi IS NOT NULL THEN 1 END) AS common_support_cells FROM grid GROUP BY band""",
)
def dimension_table(spark, d):
    return support.dimension_table(src.fixture_grid(spark, d)[0], "band")


@query("region_missing_names", "SELECT r_name AS region, n_name AS province FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990)")
def region_missing_names(spark, d):
    from gridloom.runtime import table

    nations = table(spark, d, "nation")
    named = nations.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("province"))
    rich = table(spark, d, "customer").where("c_acctbal > 9990").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("province"))
    return src.missing_names(rich, named)


@query("region_masks", f"WITH {GRID} SELECT region_name AS region, count(*) AS n_cells FROM grid WHERE province IS NOT NULL GROUP BY 1 UNION ALL SELECT 'nation', count(*) FROM grid WHERE province IS NOT NULL")
def region_masks(spark, d):
    g, _ = src.fixture_grid(spark, d)
    g = g.where("province is not null")
    masks = src.region_masks(g.select("cell", "province"), g.select(F.col("region_name").alias("region"), "province").distinct())
    return masks.groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"))


@query("raster_merge", f"WITH {GRID} SELECT cell, round(coalesce(gdp, ndvi), 4) AS value FROM grid WHERE coalesce(gdp, ndvi) IS NOT NULL")
def raster_merge(spark, d):
    g, _ = src.fixture_grid(spark, d)
    out = src.merge_layers([g.select("cell", F.col("gdp").alias("value")), g.select("cell", F.col("ndvi").alias("value"))])
    return out.select("cell", F.round("value", 4).alias("value"))


@query(
    "nearest_resample",
    f"""WITH {GRID} SELECT t.cell, round(s.gdp, 4) AS value FROM (SELECT cell, row, col FROM grid) t LEFT JOIN (SELECT row, col, gdp FROM grid WHERE col <= 50) s
    ON s.row = (t.row - 1) // 2 + 1 AND s.col = (t.col - 1) // 2 + 1""",
)
def nearest_resample(spark, d):
    g, grid = src.fixture_grid(spark, d)
    coarse = src.Grid(-(-grid.rows // 2), 50, dx=2.0, dy=2.0)
    source = g.where((F.col("col") <= 50) & (F.col("row") <= coarse.rows)).select(scalars.cell_of(F.col("row"), F.col("col"), 50).alias("cell"), F.col("gdp").alias("value"))
    return src.resample_nearest(g.select("cell", "row", "col"), grid, source, coarse).select("cell", F.round("value", 4).alias("value"))


@query(
    "bilinear_resample",
    f"""WITH {GRID}, s AS (SELECT row, col, gdp AS value FROM grid WHERE col <= 50 AND row <= (SELECT (max(row) + 1) // 2 FROM grid)), t AS (SELECT cell, (col - 0.5) / 2.0 - 0.5 AS u, (row - 0.5) / 2.0 - 0.5 AS v FROM grid),
    a AS (SELECT cell, floor(v) + 1 + dr AS r, floor(u) + 1 + dc AS c, CASE WHEN dr = 1 THEN v - floor(v) ELSE 1 - v + floor(v) END * CASE WHEN dc = 1 THEN u - floor(u) ELSE 1 - u + floor(u) END AS w FROM t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS m(dr, dc))
    SELECT a.cell, round(CAST(CASE WHEN sum(w) FILTER (value IS NOT NULL) > 0 THEN sum(value * w) / sum(w) FILTER (value IS NOT NULL) END AS DOUBLE), 6) AS value FROM a LEFT JOIN s ON s.row = r AND s.col = c GROUP BY 1""",
)
def bilinear_resample(spark, d):
    g, grid = src.fixture_grid(spark, d)
    coarse = src.Grid(-(-grid.rows // 2), 50, dx=2.0, dy=2.0)
    source = g.where((F.col("col") <= 50) & (F.col("row") <= coarse.rows)).select(scalars.cell_of(F.col("row"), F.col("col"), 50).alias("cell"), F.col("gdp").alias("value"))
    return src.resample_bilinear(g.select("cell", "row", "col"), grid, source, coarse).select("cell", F.round("value", 6).alias("value"))


SHAPES = {
    "star": [[(5.2, 3.1), (48.7, 140.3), (91.4, 8.8), (2.9, 77.2), (97.3, 81.6), (5.2, 3.1)]],
    "ring": [[(10.3, 10.4), (90.1, 12.2), (88.8, 120.6), (12.7, 118.9), (10.3, 10.4)], [(30.2, 40.1), (30.4, 80.3), (60.6, 79.2), (60.8, 41.7), (30.2, 40.1)]],
}


def _shapes_sql() -> str:
    sides = [(n, *a, *b) for n, rings in SHAPES.items() for ring in rings for a, b in zip(ring, ring[1:])]
    return "sides AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for n, x1, y1, x2, y2 in sides) + ") AS t(name, x1, y1, x2, y2))"


@query(
    "polygon_masks",
    f"WITH {GRID}, {_shapes_sql()} SELECT name, cell FROM grid CROSS JOIN sides WHERE (y1 > row - 0.5) <> (y2 > row - 0.5) AND col - 0.5 < x1 + (row - 0.5 - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1",
)
def polygon_masks(spark, d):
    _, grid = src.fixture_grid(spark, d)
    texts = [(n, "POLYGON ((" + "), (".join(", ".join(f"{x} {y}" for x, y in ring) for ring in rings) + "))") for n, rings in SHAPES.items()]
    return src.polygon_cells(spark.createDataFrame(texts, "name string, wkt string"), grid)


@query("crop_mask", f"WITH {GRID} SELECT cell, round(pop, 4) AS pop FROM grid WHERE region_name = 'ASIA' AND band = 0")
def crop_mask(spark, d):
    g, _ = src.fixture_grid(spark, d)
    return src.cut_out(g, g.where("region_name = 'ASIA' AND band = 0").select("cell", "row", "col")).select("cell", F.round("pop", 4).alias("pop"))


@query("layers_aligned", f"WITH {GRID} SELECT cell, row, col, round(gdp, 4) AS gdp, round(ndvi, 4) AS ndvi FROM grid")
def layers_aligned(spark, d):
    g, grid = src.fixture_grid(spark, d)
    parts = {n: src.layer(g.select("cell", F.col(n).alias("value")), grid) for n in ("gdp", "ndvi")}
    return support.align(parts, src.template(spark, grid), grid).select("cell", "row", "col", F.round("gdp", 4).alias("gdp"), F.round("ndvi", 4).alias("ndvi"))


# Weights


def _edge_query(name: str, contiguity: str, route: str) -> None:
    def run(spark, d):
        base, grid = _support(spark, d)
        if route == "support":
            e = weights.edges(base, grid, contiguity)
        elif route == "projection":
            e = weights.edges_by_projection(base, grid, src.template(spark, grid), contiguity)
        else:
            e = weights.edges_by_scan(base, grid, contiguity, 4_000)
        return e.select("i", "j")

    query(name, f"WITH {GRID}, {pairs_sql(contiguity)} SELECT i, j FROM pairs")(run)


for _name, _contiguity, _route in (("edges_queen", "queen", "support"), ("edges_rook", "rook", "support"), ("edges_full_lattice_projected", "queen", "projection"), ("edges_full_scan", "queen", "scan"), ("edges_full_scan_rook", "rook", "scan")):
    _edge_query(_name, _contiguity, _route)


@query(
    "route_equivalence",
    f"""WITH {GRID}, {pairs_sql()}, lattice AS (SELECT r AS row, c AS col, (r - 1) * 100 + c AS cell FROM range(1, (SELECT max(o_orderkey) // 100 + 2 FROM orders)) AS a(r) CROSS JOIN range(1, 101) AS b(c)),
    first AS (SELECT a.cell AS i, b.cell AS j FROM lattice a CROSS JOIN moves JOIN lattice b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.cell IN (SELECT cell FROM support) AND b.cell IN (SELECT cell FROM support)),
    scan AS (SELECT a.cell AS i, b.cell AS j FROM support a JOIN support b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND abs(a.col - b.col) <= 1 AND a.cell <> b.cell),
    other AS (SELECT 'support_edges' AS comparator, i, j FROM pairs UNION ALL SELECT 'full_scan', i, j FROM scan),
    met AS (SELECT comparator, first.i IS NOT NULL AS a, o.i IS NOT NULL AS b FROM (SELECT * FROM first CROSS JOIN (VALUES ('support_edges'), ('full_scan')) AS m(comparator)) first FULL JOIN other o USING (comparator, i, j)),
    n AS (SELECT comparator, count(*) FILTER (a) AS nnz_a, count(*) FILTER (b) AS nnz_b, count(*) FILTER (NOT (a AND b)) AS odd FROM met GROUP BY 1)
    SELECT comparator, nnz_a, nnz_b, nnz_a = nnz_b AS nnz_equal, odd = 0 AS structure_equal, CASE WHEN odd > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS max_abs_diff, odd AS diff_nnz, odd = 0 AS equal_within_tol FROM n""",
)
def route_equivalence(spark, d):
    base, grid = _support(spark, d)
    base = cut(base, "support")
    first = weights.edges_by_projection(base, grid, src.template(spark, grid))
    others = {"support_edges": weights.edges(base, grid), "full_scan": weights.edges_by_scan(base, grid)}
    return scalars.fill_union([weights.compare(first, e).select(F.lit(n).alias("comparator"), "*") for n, e in others.items()])


@query("degree_distribution", f"WITH {GRID}, {pairs_sql()}, {DEGREE} SELECT d AS degree, count(*) AS n_cells FROM deg GROUP BY 1")
def degree_distribution(spark, d):
    base, grid = _support(spark, d)
    return weights.degrees(weights.edges(base, grid)).groupBy("degree").agg(F.count(F.lit(1)).alias("n_cells"))


@query("isolates", f"WITH {GRID}, {pairs_sql('rook')} SELECT cell FROM support WHERE cell NOT IN (SELECT i FROM pairs)")
def isolates(spark, d):
    base, grid = _support(spark, d)
    return weights.isolates(base, weights.edges(base, grid, "rook")).select("cell")


@query("nnz_summary", f"WITH {GRID}, {pairs_sql()} SELECT (SELECT count(*) FROM pairs) AS nnz, (SELECT count(*) FROM support) AS support_cells, (SELECT count(*) FROM support WHERE cell NOT IN (SELECT i FROM pairs)) AS n_isolates")
def nnz_summary(spark, d):
    base, grid, edge = _weights(spark, d)
    deg = weights.degrees(edge)
    both = base.select("cell", F.lit(0).alias("d")).unionByName(deg.select("cell", F.col("degree").alias("d"))).groupBy("cell").agg(F.sum("d").alias("d"))
    return both.agg(F.sum("d").alias("nnz"), F.count(F.lit(1)).alias("support_cells"), F.count_if(F.col("d") == 0).alias("n_isolates"))


@query("weights_row_standardised", f"WITH {GRID}, {pairs_sql()}, {DEGREE} SELECT i, j, round(w, 8) AS w FROM w")
def weights_row_standardised(spark, d):
    base, grid = _support(spark, d)
    return weights.row_standardised(weights.edges(base, grid), symmetric=True).select("i", "j", F.round("w", 8).alias("w"))


@query("neighbour_lists", f"WITH {GRID}, {pairs_sql('rook')} SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS neighbours FROM pairs GROUP BY i")
def neighbour_lists(spark, d):
    base, grid = _support(spark, d)
    lists = weights.neighbour_lists(weights.edges(base, grid, "rook"))
    return lists.select("i", F.array_join(F.transform("neighbours", lambda n: n["j"].cast("string")), ",").alias("neighbours"))


@query("spatial_lag", f"WITH {GRID}, {pairs_sql()}, {DEGREE} SELECT w.i AS cell, max(d) AS degree, round(sum(w * ln(1 + gdp)), 6) AS lag_gdp FROM w JOIN support s ON s.cell = w.j JOIN deg ON deg.cell = w.i GROUP BY w.i")
def spatial_lag(spark, d):
    base, grid = _support(spark, d)
    base = cut(base, "support")
    w = weights.row_standardised(weights.edges(base, grid), symmetric=True)
    values = base.select(F.col("cell").alias("j"), F.log1p("gdp").alias("y"))
    return w.join(values, "j").groupBy(F.col("i").alias("cell")).agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum(F.col("w") * F.col("y")), 6).alias("lag_gdp"))


@query("weights_symmetrised", f"WITH {GRID}, {pairs_sql()}, half AS (SELECT * FROM pairs WHERE i < j) SELECT i, j, 1.0::DOUBLE AS w FROM half UNION SELECT j, i, 1.0::DOUBLE FROM half")
def weights_symmetrised(spark, d):
    base, grid = _support(spark, d)
    return weights.symmetrised(weights.edges(base, grid).where("i < j"))


@query(
    "support_summary",
    f"""WITH {GRID}, {pairs_sql()}, n AS (SELECT (SELECT max(o_orderkey) // 100 + 1 FROM orders) * 100 AS t, (SELECT count(*) FROM support) AS s, (SELECT count(DISTINCT i) FROM pairs) AS r)
    SELECT 'fixture' AS dataset, true AS mndwi_included, t AS total_template_cells, s AS common_support_cells, r AS retained_cells, s - r AS dropped_isolates, round(s / t, 6) AS share_common_support, round(r / t, 6) AS share_retained_cells FROM n""",
)
def support_summary(spark, d):
    base, grid, edge = _weights(spark, d)
    return scalars.rounded(support.support_summary("fixture", grid.size, base, weights.retained(base, edge)))


@query(
    "neumann_solve",
    f"WITH {GRID}, {pairs_sql()}, {DEGREE}, b AS (SELECT cell, ln(1 + gdp) AS b FROM support JOIN deg USING (cell)), "
    + ", ".join(f"x{k} AS (SELECT b.cell, b + 0.4 * coalesce(s, 0) AS x FROM b LEFT JOIN (SELECT i, sum(w * x) AS s FROM w JOIN x{k - 1} p ON p.cell = w.j GROUP BY i) m ON m.i = b.cell)" if k else "x0 AS (SELECT cell, b AS x FROM b)" for k in range(5))
    + " SELECT cell, round(x, 6) AS x FROM x4",
)
def neumann_solve(spark, d):
    base, grid, edge = _weights(spark, d)
    values = weights.retained(base, edge).select("cell", F.log1p("gdp").alias("b"))
    return weights.solve(weights.row_standardised(edge, symmetric=True), values, 0.4, "b", 4).select("cell", F.round("x", 6).alias("x"))


# Autocorrelation


def _moran_sql(stat: str | None) -> str:
    long = " UNION ALL ".join(f"SELECT band, '{v}' AS variable, cell, row, col, {v} AS x FROM grid WHERE {v} IS NOT NULL" for v in LAYERS)
    out = {
        "moran": "n, round(i, 6) AS moran_i, round(-1.0 / (n - 1), 8) AS moran_e, round(vi, 8) AS moran_var, round((i + 1.0 / (n - 1)) / sqrt(vi), 4) AS moran_z",
        "geary": "n, round(c, 6) AS geary_c, 1.0::DOUBLE AS geary_e, round(vc, 8) AS geary_var, round((1 - c) / sqrt(vc), 4) AS geary_z",
    }.get(stat)
    labels = " ".join(f"WHEN '{v}' THEN '{autocorr.LABELS[v]}'" for v in LAYERS)
    select = f"SELECT band, variable, {out} FROM u" if stat else f""", held AS (SELECT band, variable, count(*) AS non_na FROM long GROUP BY 1, 2), nnz AS (SELECT band, variable, count(*) AS nnz FROM p GROUP BY 1, 2)
SELECT band, CASE variable {labels} END AS variable, (SELECT max(row) FROM grid) * 100 AS total_grids, non_na, coalesce(n, 0) AS retained_non_isolates, round(i, 6) AS "moran_I", round(c, 6) AS "geary_C", round(coalesce(nnz, 0) * 24 / 1048576.0::DOUBLE, 6) AS w_tilde_mb
FROM held LEFT JOIN u USING (band, variable) LEFT JOIN nnz USING (band, variable)"""
    return f"""WITH {GRID}, moves AS (SELECT * FROM (VALUES {MOVES['queen']}) AS t(dr, dc)), long AS ({long}),
p AS (SELECT a.band, a.variable, a.cell AS i, b.cell AS j FROM long a CROSS JOIN moves JOIN long b ON b.band = a.band AND b.variable = a.variable AND b.row = a.row + dr AND b.col = a.col + dc),
deg AS (SELECT band, variable, i AS cell, CAST(count(*) AS DOUBLE) AS d FROM p GROUP BY 1, 2, 3),
m AS (SELECT band, variable, avg(x) AS mean, CAST(count(*) AS DOUBLE) AS n FROM long JOIN deg USING (band, variable, cell) GROUP BY 1, 2),
node AS (SELECT band, variable, cell, d, x - mean AS z FROM long JOIN deg USING (band, variable, cell) JOIN m USING (band, variable)),
q AS (SELECT band, variable, sum(z * z) AS z2, sum(z * z * z * z) AS z4 FROM node GROUP BY 1, 2),
r AS (SELECT p.band, p.variable, p.i, sum(a.z * b.z / a.d) AS cr, sum((a.z - b.z) * (a.z - b.z) / a.d) AS sq, sum((1 / a.d + 1 / b.d) * (1 / a.d + 1 / b.d)) AS s1, sum(1 / b.d) AS into_
      FROM p JOIN node a ON a.band = p.band AND a.variable = p.variable AND a.cell = p.i JOIN node b ON b.band = p.band AND b.variable = p.variable AND b.cell = p.j GROUP BY 1, 2, 3),
s AS (SELECT band, variable, sum(cr) AS cr, sum(sq) AS sq, sum(s1) / 2 AS s1, sum((1 + into_) * (1 + into_)) AS s2 FROM r GROUP BY 1, 2),
t AS (SELECT band, variable, n, z2, cr, sq, s1, s2, n * z4 / (z2 * z2) AS k FROM s JOIN q USING (band, variable) JOIN m USING (band, variable)),
u AS (SELECT band, variable, CAST(n AS BIGINT) AS n, cr / z2 AS i, (n - 1) / (2 * n) * sq / z2 AS c,
      (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * n * n) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * n * n)) / ((n - 1) * (n - 2) * (n - 3) * n * n) - 1.0 / ((n - 1) * (n - 1)) AS vi,
      ((n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * k) - 0.25 * (n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * k) + n * n * (n * n - 3 - (n - 1) * (n - 1) * k)) / (n * (n - 2) * (n - 3) * n * n) AS vc FROM t)
{select}"""


def _moran(spark, d):
    g, grid = src.fixture_grid(spark, d)
    return autocorr.moments(autocorr.long_form(g, LAYERS, ["band"]), grid, keys=["band"])


@query("moran", _moran_sql("moran"))
def moran(spark, d):
    return _moran(spark, d).select("band", "variable", "n", F.round("moran_i", 6).alias("moran_i"), F.round("moran_e", 8).alias("moran_e"), F.round("moran_var", 8).alias("moran_var"), F.round("moran_z", 4).alias("moran_z"))


@query("geary", _moran_sql("geary"))
def geary(spark, d):
    return _moran(spark, d).select("band", "variable", "n", F.round("geary_c", 6).alias("geary_c"), "geary_e", F.round("geary_var", 8).alias("geary_var"), F.round("geary_z", 4).alias("geary_z"))


@query("autocorrelation_suite", _moran_sql(None))
def autocorrelation_suite(spark, d):
    """The suite's report without its seconds and p-values, which SQL can't repeat."""
    g, grid = src.fixture_grid(spark, d)
    out = regression.run_autocorrelation(g, grid, key="band")
    return out.select("band", "variable", "total_grids", "non_na", "retained_non_isolates", *[F.round(c, 6).alias(c) for c in ("moran_I", "geary_C", "w_tilde_mb")])


# Models


@query("design_matrix", f"WITH {GRID}, {pairs_sql()}, {DEGREE}, {KEPT}, {SAMPLE} SELECT cell, round(y, 6) AS y, intercept::DOUBLE AS intercept, round(pop, 6) AS pop, round(ndvi, 6) AS ndvi, round(mndwi, 6) AS mndwi FROM sample")
def design_matrix(spark, d):
    base, grid, edge = _weights(spark, d)
    return scalars.rounded(support.design(weights.retained(base, edge)))


def _moments_sql(names: list[str]) -> str:
    columns = [*names, "y", "wy"]
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a.lower()} * {b.lower()}) / count(*), 6) + 0.0 AS mean_product, count(*) AS n FROM model" for i, a in enumerate(columns) for b in columns[i:]]
    return f"WITH {GRID}, {pairs_sql()}, {DEGREE}, {KEPT}, {SAMPLE} " + " UNION ALL ".join(parts)


def _moments(spark, d, model):
    sample, w, _ = _sample(spark, d)
    rows, names = models.model_rows(sample, w, model)
    m = models.moments(rows, names)
    columns = [*names, "y", "wy"]
    full = {}
    for i, a in enumerate(names):
        full |= {(a, b): m.xx[i, j] for j, b in enumerate(names)} | {(a, "y"): m.xy[i], (a, "wy"): m.xl[i]}
    full |= {("y", "y"): m.yy, ("y", "wy"): m.yl, ("wy", "wy"): m.ll}
    out = [(a, b, float(full[a, b]) / m.n, m.n) for i, a in enumerate(columns) for b in columns[i:]]
    return scalars.rounded(spark.createDataFrame(out, "a string, b string, mean_product double, n long"))


X = ["intercept", "pop", "ndvi", "mndwi"]
query("moments_sar", _moments_sql(X))(lambda spark, d: _moments(spark, d, "sar"))
query("moments_sdm", _moments_sql([*X, "W_pop", "W_ndvi", "W_mndwi"]))(lambda spark, d: _moments(spark, d, "sdm"))

TRACES = f"""WITH {GRID}, {pairs_sql()}, {DEGREE}, tr AS (SELECT CAST(1 AS BIGINT) AS k, 0.0::DOUBLE AS tr UNION ALL SELECT 2, sum(a.w * b.w) FROM w a JOIN w b ON a.i = b.j AND a.j = b.i
UNION ALL SELECT 3, sum(a.w * b.w * c.w) FROM w a JOIN w b ON a.j = b.i JOIN w c ON c.i = b.j AND c.j = a.i)"""


@query("trace_exact_low_order", f"{TRACES} SELECT k, round(tr, 4) AS tr FROM tr")
def trace_exact_low_order(spark, d):
    base, grid, edge = _weights(spark, d)
    return traces.exact_traces(weights.row_standardised(edge, symmetric=True)).select("k", F.round("tr", 4).alias("tr"))


def _signs_sql(b: int, seed: int) -> str:
    p = 2147483647
    return f"""h1_{b} AS (SELECT cell, (cell * 1103515245 + {b * 104729 + seed * 15485863}) % {p} AS h FROM kept), h2_{b} AS (SELECT cell, (h * h + {b * 7919 + 12345}) % {p} AS h FROM h1_{b}),
h3_{b} AS (SELECT cell, (h * 48271 + cell) % {p} AS h FROM h2_{b}), v_{b} AS (SELECT cell, CASE WHEN ((h * h) % {p}) // 65536 % 2 = 0 THEN 1.0 ELSE -1.0 END AS v FROM h3_{b})"""


@query(
    "trace_mc_hashed",
    f"WITH {GRID}, {pairs_sql()}, {DEGREE}, {KEPT}, "
    + ", ".join(_signs_sql(b, 42) + f", z{b}_0 AS (SELECT cell, v AS z FROM v_{b}), " + ", ".join(f"z{b}_{k} AS (SELECT i AS cell, sum(w * z) AS z FROM w JOIN z{b}_{k - 1} p ON p.cell = w.j GROUP BY i)" for k in range(1, 5)) for b in range(2))
    + " "
    + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(((SELECT sum(v * z) FROM v_0 JOIN z0_{k} USING (cell)) + (SELECT sum(v * z) FROM v_1 JOIN z1_{k} USING (cell))) / 2, 4) AS tr" for k in range(1, 5)),
)
def trace_mc_hashed(spark, d):
    base, grid, edge = _weights(spark, d)
    tr = traces.traces(weights.row_standardised(edge, symmetric=True), weights.retained(base, edge), 4, 2, 42)
    return spark.createDataFrame(list(enumerate(tr, 1)), "k long, tr double").select("k", F.round("tr", 4).alias("tr"))


RHOS = [-0.8, -0.4, 0.0, 0.3, 0.6, 0.9]


@query(
    "logdet_series",
    f"{TRACES} SELECT rho::DOUBLE AS rho, round(-sum(power(rho, k) * tr / k), 4) + 0.0 AS logdet, round(sum(power(rho, k - 1) * tr), 4) AS slope FROM tr CROSS JOIN (VALUES {', '.join(f'({r}::DOUBLE)' for r in RHOS)}) AS g(rho) GROUP BY rho",
)
def logdet_series(spark, d):
    base, grid, edge = _weights(spark, d)
    tr = [r["tr"] for r in traces.exact_traces(weights.row_standardised(edge, symmetric=True)).orderBy("k").collect()]
    return spark.createDataFrame([(r, round(traces.logdet(r, tr), 4) + 0.0, round(traces.logdet_slope(r, tr), 4)) for r in RHOS], "rho double, logdet double, slope double")


BETA = [5.0, 0.1, -0.05, 0.02]


@query(
    "hc_meat",
    f"WITH {GRID}, {pairs_sql()}, {DEGREE}, {KEPT}, {SAMPLE}, e AS (SELECT *, y - 0.5 * wy - (5.0 + 0.1 * pop - 0.05 * ndvi + 0.02 * mndwi) AS e FROM model) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(e * e * {a} * {b}) / count(*), 6) AS mean_product FROM e" for i, a in enumerate(X) for b in X[i:]),
)
def hc_meat(spark, d):
    import numpy as np

    sample, w, _ = _sample(spark, d)
    rows, names = models.model_rows(sample, w)
    rows = cut(rows, "rows")
    got = models.meat(rows, names, 0.5, np.array(BETA)) / rows.count()
    return scalars.rounded(spark.createDataFrame([(a, b, float(got[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j], "a string, b string, mean_product double"))


KMAX, PROBES = 20, 10
XL = [*X, "W_pop", "W_ndvi", "W_mndwi"]
FITTED = f"WITH {GRID}, {pairs_sql()}, {DEGREE}, {KEPT}, {SAMPLE}, {fit_sql.trace_ctes(KMAX, PROBES, 42)}, "


def _fitted(spark, d, **settings):
    g, grid = src.fixture_grid(spark, d)
    return regression.run_region(g, grid, "fixture", kmax=KMAX, probes=PROBES, exact_low_order=True, **settings)


def _shown(df, names):
    return df.select(*[(F.round(c, fit_sql.SIGNIFICANT) + 0.0).alias(n) if t == "double" else F.col(c).alias(n) for c, n in names.items() for t in [dict(df.dtypes)[c]]])


COEFFICIENTS = {c: c for c in ("term", "estimate", "se_mle", "se_hc1")}


@query("sar_fit", FITTED + fit_sql.fit_ctes(X) + fit_sql.coefficients(X))
def sar_fit(spark, d):
    r = _fitted(spark, d)
    regression.inference(r, "conditional", run_blocks=False)
    return _shown(models.coefficients(r.fits["sar"], spark), COEFFICIENTS)


@query("sdm_fit", FITTED + fit_sql.fit_ctes(XL) + fit_sql.coefficients(XL))
def sdm_fit(spark, d):
    r = _fitted(spark, d)
    regression.inference(r, "conditional", run_blocks=False)
    return _shown(models.coefficients(r.fits["sdm"], spark), COEFFICIENTS)


FULL = {"term": "term", "estimate": "estimate", "se_hc1": "se_full"}


@query("full_hc1", FITTED + fit_sql.fit_ctes(XL) + fit_sql.full_errors(XL))
def full_hc1(spark, d):
    r = _fitted(spark, d)
    regression.inference(r, "full", run_blocks=False)
    return _shown(models.coefficients(r.fits["sdm"], spark, "full_HC1"), FULL)


@query("full_hc1_sar", FITTED + fit_sql.fit_ctes(X) + fit_sql.full_errors(X))
def full_hc1_sar(spark, d):
    r = _fitted(spark, d)
    regression.inference(r, "full", run_blocks=False)
    return _shown(models.coefficients(r.fits["sar"], spark, "full_HC1"), FULL)


def _impacts(spark, d, model):
    names = {c: c for c in ("model", "variable", "direct", "indirect", "total")}
    return _shown(models.impact_table(_fitted(spark, d).fits[model], spark).withColumn("model", F.lit(model)), names)


query("impacts", FITTED + fit_sql.fit_ctes(XL) + fit_sql.impacts(XL, "sdm"))(lambda spark, d: _impacts(spark, d, "sdm"))
query("impacts_sar", FITTED + fit_sql.fit_ctes(X) + fit_sql.impacts(X, "sar"))(lambda spark, d: _impacts(spark, d, "sar"))


def _quality(spark, d, model):
    r = _fitted(spark, d)
    return models.fit_table([r.fits[model]], spark).select("model", "n", *[F.round(c, 4).alias(c) for c in ("logLik", "AIC", "BIC")])


query("model_fit_sar", FITTED + fit_sql.fit_ctes(X) + fit_sql.quality(X, "SAR"))(lambda spark, d: _quality(spark, d, "sar"))
query("model_fit_sdm", FITTED + fit_sql.fit_ctes(XL) + fit_sql.quality(XL, "SDM"))(lambda spark, d: _quality(spark, d, "sdm"))


@query("sbs_draws")
def sbs_draws(spark, d):
    sample, w, grid = _sample(spark, d)
    placed = sample.withColumns({"row": scalars.row_of(F.col("cell"), grid.cols), "col": scalars.col_of(F.col("cell"), grid.cols)})
    return blocks.draws(placed, w, grid, "sar", k=10, m=100, seed=123, kmax=20, probes=10)


@query("region_export_tables")
def region_export_tables(spark, d):
    g, grid = src.fixture_grid(spark, d)
    _, tables = regression.run_and_export(g, grid, "fixture", None, run_blocks=False, kmax=12, probes=6)
    return spark.createDataFrame([(n, len(t.columns), t.count()) for n, t in tables.items()], "sheet string, n_columns long, n_rows long")


# Scenarios and graphs


def _shuffle_sql(seed: int, of: str = "support") -> str:
    p = 2147483647
    return f"""s1 AS (SELECT cell, (cell * 1103515245 + {seed * 15485863 + 12345}) % {p} AS h FROM {of}), s2 AS (SELECT cell, (h * h + 7919) % {p} AS h FROM s1), s3 AS (SELECT cell, (h * 48271 + cell) % {p} AS h FROM s2),
placed AS (SELECT cell, row_number() OVER (ORDER BY (h * h) % {p}, cell) AS place, count(*) OVER () AS v FROM s3)"""


SHARES = [0.01, 0.1, 0.5, 1.0]
TAKES = "takes AS (SELECT * FROM (VALUES ('1pct', 0.01), ('10pct', 0.1), ('50pct', 0.5), ('100pct', 1.0)) AS t(scenario, share))"
PREFIX = "scenario AS (SELECT scenario, cell, v FROM placed CROSS JOIN takes WHERE place <= greatest(1, CAST(floor(share::DOUBLE * v + 1e-9) AS BIGINT)))"


@query("random_nested_supports", f"WITH {GRID}, {_shuffle_sql(42)}, {TAKES}, {PREFIX} SELECT scenario, cell FROM scenario")
def random_nested_supports(spark, d):
    return scenarios.random_supports(_support(spark, d)[0], SHARES, 42)


@query("scenario_sizes", f"WITH {GRID}, {_shuffle_sql(42)}, {TAKES}, {PREFIX} SELECT scenario, count(*) AS n_cells, round(count(*) * 100.0::DOUBLE / max(v), 4) AS pct_of_full_common_support FROM scenario GROUP BY 1")
def scenario_sizes(spark, d):
    base, grid = _support(spark, d)
    return scenarios.prepare(cut(base, "support"), grid, SHARES, "random")[1]


@query("scenario_labels", "SELECT share, replace(regexp_replace(printf('%.4f', share * 100), '\\.?0+$', ''), '.', 'p') || 'pct' AS label FROM (VALUES (0.0001::DOUBLE), (0.005::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) AS t(share)")
def scenario_labels(spark, d):
    return spark.createDataFrame([(s, scalars.share_label(s)) for s in scalars.proportions([1, 0.1, 0.005, 0.0001])], "share double, label string")


ALLOCATED = """WITH sizes AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(39 AS BIGINT)), (2, 14), (3, 6)) AS t(component, n)), q AS (SELECT k, component, n, n * k / 59.0::DOUBLE AS quota FROM sizes CROSS JOIN (VALUES (14), (15), (30)) AS ks(k)),
r AS (SELECT k, component, n, floor(quota) AS base, row_number() OVER (PARTITION BY k ORDER BY round(quota - floor(quota), 12) DESC, component) AS place, k - sum(floor(quota)) OVER (PARTITION BY k) AS spare FROM q)
SELECT CAST(k AS BIGINT) AS k, component, n, CAST(least(n, base + CASE WHEN place <= spare THEN 1 ELSE 0 END) AS BIGINT) AS take FROM r"""


@query("component_allocation", ALLOCATED)
def component_allocation(spark, d):
    sizes = spark.createDataFrame([(1, 39), (2, 14), (3, 6)], "component long, n long")
    return scalars.fill_union([scenarios.allocate(sizes, k, 59).select(F.lit(k).cast("bigint").alias("k"), "component", "n", "take") for k in (14, 15, 30)])




def _components_sql(contiguity: str, rounds: int = 300) -> str:
    """parts(component, cell): every cell takes the least label around it, then its label's label; such rounds settle
    in about the logarithm of the longest way."""
    return f"""{pairs_sql(contiguity)},
near(step, cell, lab) AS (SELECT 0, cell, cell FROM support UNION ALL
    SELECT t.step + 1, t.cell, u.lab FROM (SELECT a.step, a.cell, least(a.lab, coalesce(min(b.lab), a.lab)) AS lab FROM near a LEFT JOIN pairs ON pairs.i = a.cell LEFT JOIN near b ON b.cell = pairs.j GROUP BY a.step, a.cell, a.lab) t
    JOIN near u ON u.cell = t.lab WHERE t.step < {rounds}),
parts AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY lab) AS component, near.cell, row, col FROM near JOIN support ON support.cell = near.cell WHERE step = {rounds})"""


SEEDS = """middle AS (SELECT component, avg(row) AS r, avg(col) AS c FROM parts GROUP BY 1),
seeds AS MATERIALIZED (SELECT component, min_by(cell, (round((row - r) * (row - r) + (col - c) * (col - c), 9), cell)) AS cell FROM parts JOIN middle USING (component) GROUP BY 1)"""
# first in, first out: a cell's place follows its first parent's, then the step from it; levels carry all that was seen
ORDER = """ranked AS MATERIALIZED (SELECT component, a.cell AS i, b.cell AS j, o FROM parts a CROSS JOIN (VALUES (-1,0,0),(1,0,1),(0,-1,2),(0,1,3),(-1,-1,4),(-1,1,5),(1,-1,6),(1,1,7)) AS t(dr, dc, o) JOIN support b ON b.row = a.row + dr AND b.col = a.col + dc),
walk(step, component, cell, place) AS (SELECT 0, component, cell, CAST(1 AS BIGINT) FROM seeds UNION ALL
    SELECT step + 1, component, cell, place FROM (
        SELECT step, component, cell, place, false AS fresh FROM walk
        UNION ALL SELECT f.step, f.component, f.cell, l.last + row_number() OVER (PARTITION BY f.component ORDER BY f.by_), true FROM (
            SELECT w.step, r.component, r.j AS cell, min(w.place * 10 + r.o) AS by_ FROM walk w JOIN ranked r ON r.i = w.cell WHERE r.j NOT IN (SELECT cell FROM walk) GROUP BY 1, 2, 3) f
        JOIN (SELECT component, max(place) AS last FROM walk GROUP BY 1) l ON l.component = f.component) x WHERE step < {steps}),
places AS MATERIALIZED (SELECT component, cell, place FROM walk WHERE step = {steps})"""


@query("connected_components", f"WITH RECURSIVE {GRID}, {_components_sql('rook')} SELECT component, cell FROM parts")
def connected_components(spark, d):
    base, grid = _support(spark, d)
    return scenarios.labelled(cut(base, "support"), grid, "rook").select("component", "cell")


@query("connected_component_sizes", f"WITH RECURSIVE {GRID}, {_components_sql('queen')} SELECT component, count(*) AS n_cells FROM parts GROUP BY 1")
def connected_component_sizes(spark, d):
    base, grid = _support(spark, d)
    return scenarios.labelled(cut(base, "support"), grid).groupBy("component").agg(F.count(F.lit(1)).alias("n_cells"))


@query("component_seed_cells", f"WITH RECURSIVE {GRID}, {_components_sql('rook')}, {SEEDS} SELECT component, cell FROM seeds")
def component_seed_cells(spark, d):
    base, grid = _support(spark, d)
    return scenarios.seeds(scenarios.labelled(cut(base, "support"), grid, "rook"))


@query(
    "reach_within_6_steps",
    f"""WITH RECURSIVE {GRID}, {pairs_sql()}, reach(cell, level) AS (SELECT min(cell), CAST(0 AS BIGINT) FROM support UNION SELECT j, level + 1 FROM reach JOIN pairs ON i = cell WHERE level < 6)
    SELECT cell, min(level) AS level FROM reach GROUP BY cell""",
)
def reach_within_6_steps(spark, d):
    base, grid, edge = _weights(spark, d)
    return search.levels(edge, base.agg(F.min("cell").alias("cell")), 6)


@query("bfs_orders", f"WITH RECURSIVE {GRID}, {_components_sql('queen')}, {SEEDS}, {ORDER.replace('{steps}', '400')} SELECT component, cell, place FROM places")
def bfs_orders(spark, d):
    base, grid = _support(spark, d)
    base = cut(base, "support")
    parts = cut(scenarios.labelled(base, grid), "labelled")
    ranked = cut(weights.edges(base, grid, ranked=True).join(parts.select("component", F.col("cell").alias("i")), "i").select("component", "i", "o", "j"), "ranked")
    return search.orders(ranked, cut(scenarios.seeds(parts), "seeds"), parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")), grid=grid)


ALLOCATION = """counts AS (SELECT component, count(*) AS n FROM parts GROUP BY 1), whole AS (SELECT scenario, greatest(1, CAST(floor(share::DOUBLE * t + 1e-9) AS BIGINT)) AS k, t FROM takes CROSS JOIN (SELECT sum(n) AS t FROM counts)),
quota AS (SELECT scenario, k, component, n, n * (k * 1.0::DOUBLE) / t AS q FROM counts CROSS JOIN whole),
given AS (SELECT scenario, component, least(n, floor(q) + CASE WHEN row_number() OVER (PARTITION BY scenario ORDER BY round(q - floor(q), 12) DESC, component) <= k - sum(floor(q)) OVER (PARTITION BY scenario) THEN 1 ELSE 0 END) AS take FROM quota)"""


@query("spatial_nested_supports", f"WITH RECURSIVE {GRID}, {_components_sql('queen')}, {SEEDS}, {ORDER.replace('{steps}', '400')}, {TAKES}, {ALLOCATION} SELECT scenario, cell FROM places JOIN given USING (component) WHERE place <= take")
def spatial_nested_supports(spark, d):
    base, grid = _support(spark, d)
    return scenarios.spatial_supports(cut(base, "support"), grid, SHARES)


# Benchmark tables

_RAW = [
    ("10pct", "projection", 1, "ok", 10, 2.0, 1048576.0, "", ""), ("10pct", "projection", 2, "ok", 10, 4.0, 1048576.0, "", ""), ("10pct", "support_edges", 1, "ok", 10, 1.0, 524288.0, "", "slow disk"),
    ("10pct", "support_edges", 2, "ok", 10, float("inf"), 524288.0, "", ""), ("10pct", "full_scan", 1, "failed", 10, None, None, "cannot allocate memory", ""), ("10pct", "full_scan", 2, "failed", 10, None, None, "cannot allocate memory", ""),
    ("100pct", "projection", 1, "ok", 100, 5.0, 2097152.0, "", ""), ("100pct", "support_edges", 1, "ok", 100, 10.0, 4194304.0, "", ""), ("100pct", "full_scan", 1, "failed", 100, None, None, "subscript out of bounds", "odd shape"),
]
_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else "'Infinity'::DOUBLE" if x == float("inf") else str(x) if isinstance(x, int) else f"{x}::DOUBLE"
RAW = "raw AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in _RAW) + ") AS t(scenario, method, rep, status, cells_input, elapsed_total, peak_object_bytes, error, warning_message))"
SUMMARY = RAW + """, med AS (SELECT scenario, method, count(*) AS runs, count(CASE WHEN status = 'ok' THEN 1 END) AS ok_runs, count(CASE WHEN status <> 'ok' THEN 1 END) AS failed_runs,
 median(cells_input)::DOUBLE AS cells_input, median(CASE WHEN isfinite(elapsed_total) THEN elapsed_total END) AS elapsed_total, median(CASE WHEN isfinite(peak_object_bytes) THEN peak_object_bytes END) AS peak_object_bytes,
 coalesce(string_agg(DISTINCT CASE WHEN error <> '' THEN error END, ' | '), '') AS failure_message, coalesce(string_agg(DISTINCT CASE WHEN warning_message <> '' THEN warning_message END, ' | '), '') AS warning_messages FROM raw GROUP BY 1, 2)"""


def _raw(spark):
    return spark.createDataFrame(_RAW, "scenario string, method string, rep int, status string, cells_input long, elapsed_total double, peak_object_bytes double, error string, warning_message string")


@query("bench_summary", f"WITH {SUMMARY} SELECT *, peak_object_bytes / 1048576 AS peak_object_mb FROM med")
def bench_summary(spark, d):
    return benchmark.summarise(_raw(spark))


@query(
    "bench_gain",
    f"""WITH {SUMMARY}, m AS (SELECT *, peak_object_bytes / 1048576 AS mb FROM med), b AS (SELECT scenario, elapsed_total AS et, mb AS pm FROM m WHERE method = 'projection')
    SELECT scenario, method, cells_input, et AS elapsed_total_prop, elapsed_total, elapsed_total / et AS time_ratio_alt_over_prop, CASE WHEN elapsed_total / et < 1 THEN method ELSE 'projection' END AS faster_method,
    pm AS peak_object_mb_prop, mb AS peak_object_mb, mb / pm AS memory_ratio_alt_over_prop, CASE WHEN mb / pm < 1 THEN method ELSE 'projection' END AS lower_memory_method, ok_runs, failed_runs, failure_message
    FROM m LEFT JOIN b USING (scenario) WHERE method <> 'projection'""",
)
def bench_gain(spark, d):
    return benchmark.gain(benchmark.summarise(_raw(spark)))


_CHECKS = [("10pct", "full_scan", 1, True, True, True, 0.0), ("10pct", "full_scan", 2, True, False, False, 1e-9), ("100pct", "full_scan", 1, None, None, False, None), ("100pct", "support_edges", 1, True, True, True, 0.0)]
_flag = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else _lit(x)


@query(
    "validation_summary",
    "WITH v AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_flag, r)) + ")" for r in _CHECKS) + """) AS t(scenario, comparator_method, rep, common_equal, final_equal, output_equivalence_ok, final_max_abs_diff))
    SELECT scenario, comparator_method, count(*) AS comparisons, count(CASE WHEN output_equivalence_ok THEN 1 END) AS equivalent, coalesce(bool_and(common_equal), true) AS all_common_equal, coalesce(bool_and(final_equal), true) AS all_final_equal,
    coalesce(bool_and(output_equivalence_ok), true) AS all_output_equivalence_ok, max(final_max_abs_diff) AS max_final_max_abs_diff, median(final_max_abs_diff) AS median_final_max_abs_diff FROM v GROUP BY 1, 2""",
)
def validation_summary(spark, d):
    return benchmark.summarise_checks(spark.createDataFrame(_CHECKS, "scenario string, comparator_method string, rep int, common_equal boolean, final_equal boolean, output_equivalence_ok boolean, final_max_abs_diff double"))


@query("bind_fill", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b')) AS t(id, name) UNION ALL BY NAME SELECT * FROM (VALUES (CAST(3 AS BIGINT), 0.5::DOUBLE)) AS u(id, share)")
def bind_fill(spark, d):
    return scalars.fill_union([spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), spark.createDataFrame([(3, 0.5)], "id long, share double")])


_FAILURES = [(1, "Error: cannot allocate vector of size 2 Gb", ""), (2, "subscript out of bounds", ""), (3, "something else", ""), (4, "", "reached elapsed time limit"), (5, "", ""), (6, "java.lang.OutOfMemoryError: Java heap space", ""), (7, "std::bad_alloc", ""), (8, "negative length vectors are not allowed", ""), (9, "", "long vectors not supported yet"), (10, "Allocation failure", "")]


_HARD_SQL = " OR ".join(f"regexp_matches(lower(m), '{p}')" for p in [*scalars.HARD, *scalars.HARD_HERE])


@query(
    "failure_class",
    "WITH said AS (SELECT id, trim(error || ' ' || warning) AS m FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{e}', '{w}')" for i, e, w in _FAILURES) + f""") AS t(id, error, warning))
    SELECT id, CASE WHEN m = '' THEN NULL WHEN {_HARD_SQL} THEN 'hard' ELSE 'soft' END AS failure_class FROM said""",
)
def failure_class(spark, d):
    df = spark.createDataFrame(_FAILURES, "id long, error string, warning string")
    return df.select("id", scalars.failure_class(F.nullif(F.col("error"), F.lit("")), F.nullif(F.col("warning"), F.lit(""))).alias("failure_class"))


@query("round_and_format", "SELECT id, round(x, 6) AS x, bytes_w, bytes_w / 1048576 AS bytes_w_mb, TRY_CAST(n AS DOUBLE) AS n FROM (VALUES (CAST(1 AS BIGINT), 1.23456789::DOUBLE, 1048576.0::DOUBLE, '2.5'), (2, -2.0, 524288.0, 'n/a')) AS t(id, x, bytes_w, n)")
def round_and_format(spark, d):
    df = spark.createDataFrame([(1, 1.23456789, 1048576.0, "2.5"), (2, -2.0, 524288.0, "n/a")], "id long, x double, bytes_w double, n string")
    return scalars.rounded(scalars.with_megabytes(scalars.numbers(df, ["id"])))


@query(
    "benchmark_routes",
    f"""WITH {GRID}, {_shuffle_sql(42)}, shares AS (SELECT * FROM (VALUES ('10pct', 0.1), ('100pct', 1.0)) AS t(scenario, share)), moves AS (SELECT * FROM (VALUES {MOVES['queen']}) AS t(dr, dc)),
    chosen AS (SELECT scenario, cell, row, col FROM placed JOIN support USING (cell) CROSS JOIN shares WHERE place <= greatest(1, CAST(floor(share::DOUBLE * v + 1e-9) AS BIGINT))),
    near AS (SELECT a.scenario, a.cell, count(b.cell) AS d FROM chosen a CROSS JOIN moves LEFT JOIN chosen b ON b.scenario = a.scenario AND b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2)
    SELECT scenario, method, 'ok' AS status, count(*) AS cells_input, count(*) FILTER (d > 0) AS cells_after_prune, count(*) FILTER (d = 0) AS n_isolates, CAST(sum(d) AS BIGINT) AS nnz_final, agrees AS output_equivalence_ok
    FROM near CROSS JOIN (VALUES ('projection', NULL::BOOLEAN), ('support_edges', true), ('full_scan', true)) AS m(method, agrees) GROUP BY ALL""",
)
def benchmark_routes(spark, d):
    """The harness itself over two supports: sizes and equality of the routes, without the times."""
    base, grid = _support(spark, d)
    base = cut(base, "support")
    got = benchmark.run_benchmark(scenarios.random_supports(base, [0.1, 1.0]), base, grid, reps=1, timeout=600)
    checks = got["validation"].select("scenario", F.col("comparator_method").alias("method"), "output_equivalence_ok")
    return got["raw"].select("scenario", "method", "status", "cells_input", "cells_after_prune", "n_isolates", "nnz_final").join(checks, ["scenario", "method"], "left")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Degree and spatial lag of every cell."""
    return spatial_lag(spark, d)


