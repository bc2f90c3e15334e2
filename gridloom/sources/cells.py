"""Layers, masks and regions as cell tables: (name, cell, row, col, value), one row a non-missing grid cell."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import cell_of, col_of, inside, present, row_of
from gridloom.runtime import table

LAYERS = ["gdp", "pop", "ndvi", "mndwi"]


@dataclass
class Grid:
    """rows x cols cells, numbered from 1 in row-major order; x0, y0 is the upper left corner, dx and dy the cell size."""

    rows: int
    cols: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0

    @property
    def size(self) -> int:
        return self.rows * self.cols


@dataclass
class Config:
    """What a run reads and does. layer_path and mask_path are templates with {name}, {year} and {tag}."""

    layer_path: str = ""
    mask_path: str = ""
    out_dir: str | None = None
    year: int = 2020
    regions: list[str] = field(default_factory=list)
    region_tags: dict[str, str] = field(default_factory=dict)
    contiguity: str = "queen"
    run_autocorrelation: bool = True
    run_regression: bool = True
    run_blocks: bool = True
    blocks: int = 30
    block_cells: int = 500
    seed: int = 42
    required: tuple[str, ...] = ("layer_path",)

    def checked(self) -> Config:
        missing = [n for n in self.required if not getattr(self, n)]
        if missing:
            raise ValueError(f"missing in the configuration: {', '.join(missing)}")
        return self


def template(spark: SparkSession, grid: Grid) -> DataFrame:
    """(cell, row, col) of every cell, generated by arithmetic on the executors."""
    return spark.range(1, grid.size + 1).select(F.col("id").alias("cell"), row_of(F.col("id"), grid.cols).alias("row"), col_of(F.col("id"), grid.cols).alias("col"))


def layer(df: DataFrame, grid: Grid, value: str = "value", cell: str = "cell") -> DataFrame:
    """(cell, row, col, value) of one layer in raster order numbers; NaN becomes null.

    Cells outside the grid are an error, found by one aggregate: the layer then has another geometry.
    """
    out = df.select(F.col(cell).cast("bigint").alias("cell"), F.col(value).cast("double").alias("value"))
    outside = out.agg(F.min("cell").alias("a"), F.max("cell").alias("b")).first()
    if outside["a"] is not None and (outside["a"] < 1 or outside["b"] > grid.size):
        raise ValueError(f"cells {outside['a']} to {outside['b']} don't lie in a grid of {grid.rows} x {grid.cols}")
    return out.select("cell", row_of(F.col("cell"), grid.cols).alias("row"), col_of(F.col("cell"), grid.cols).alias("col"), F.when(present(F.col("value")), F.col("value")).alias("value"))


def pick_layer(layers: DataFrame, name: str) -> DataFrame:
    """One layer of a long table by its name, such as gdp_2020; an error names the ones there are."""
    out = layers.where(F.col("layer") == name)
    if out.isEmpty():
        known = [r[0] for r in layers.select("layer").distinct().orderBy("layer").limit(50).collect()]
        raise ValueError(f"no layer {name}; there are {known}")
    return out.drop("layer")


def read_layer(spark: SparkSession, config: Config, name: str, tag: str = "") -> DataFrame:
    """The cell table at the configured path, by name, year and region tag."""
    return spark.read.parquet(config.checked().layer_path.format(name=name, year=config.year, tag=tag))


def open_sources(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """The national layers, lazily: gdp (picked by year from a long table) and the year's pop."""
    return {"gdp": read_layer(spark, config, "gdp"), "pop": read_layer(spark, config, "pop")}


def region_inputs(spark: SparkSession, config: Config, region: str, masks: DataFrame, national: str = "nation") -> DataFrame:
    """(region, cell, gdp, pop, ndvi, mndwi) within the region's mask; the whole nation is merged, not loaded."""
    if region == national:
        raise ValueError(f"{national} is merged from its regions, not loaded")
    sources = open_sources(spark, config)
    mask = masks.where(F.col("region") == region).select("cell")
    gdp = sources["gdp"]
    gdp = pick_layer(gdp, f"gdp_{config.year}") if "layer" in gdp.columns else gdp
    tag = config.region_tags.get(region, region)
    out = None
    for name, df in {"gdp": gdp, "pop": sources["pop"], **{n: read_layer(spark, config, n, tag) for n in ("ndvi", "mndwi")}}.items():
        part = df.join(mask, "cell", "left_semi").select("cell", F.col("value").cast("double").alias(name))
        out = part if out is None else out.join(part, "cell", "full_outer")
    return out.select(F.lit(region).alias("region"), "cell", *LAYERS)


def all_regions(spark: SparkSession, config: Config, masks: DataFrame, national: str = "nation", view: str | None = None) -> DataFrame:
    """One long table of all configured regions and, merged from them, the nation; kept as a temporary view if named."""
    parts = [region_inputs(spark, config, r, masks, national) for r in config.checked().regions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    priority = F.create_map(*[x for i, r in enumerate(config.regions) for x in (F.lit(r), F.lit(i))])
    merged = out.groupBy("cell").agg(*[F.min_by(n, F.when(present(F.col(n)), priority[F.col("region")])).alias(n) for n in LAYERS])
    out = out.unionByName(merged.select(F.lit(national).alias("region"), "cell", *LAYERS))
    if view:
        out.createOrReplaceTempView(view)
    return out


def loaded_inputs(spark: SparkSession, names: list[str]) -> DataFrame:
    """The first of these tables or views that the session has."""
    for n in names:
        if spark.catalog.tableExists(n):
            return spark.table(n)
    raise LookupError(f"none of {names} is loaded")


def read_support(spark: SparkSession, path: str) -> DataFrame:
    """A support written before; an error if columns are missing."""
    out = spark.read.parquet(path)
    missing = [c for c in ("cell", "row", "col", *LAYERS) if c not in out.columns]
    if missing:
        raise ValueError(f"no support at {path}: it lacks {missing}")
    return out


def cached_support(spark: SparkSession, path: str | None, build) -> DataFrame:
    """The support at ``path``, built and written there first if it is absent."""
    if not path:
        return build()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return read_support(spark, path)


def region_masks(provinces: DataFrame, region_map: DataFrame, national: str | None = "nation") -> DataFrame:
    """(region, cell) from (cell, province) and (region, province), and the nation of all of them.

    Provinces of the map that no cell has, and regions without a cell, are errors that list their names.
    """
    missing = missing_names(provinces, region_map).groupBy("region").agg(F.sort_array(F.collect_set("province")).alias("names")).orderBy("region").collect()
    if missing:
        raise ValueError("provinces without cells: " + "; ".join(f"{r['region']}: {', '.join(r['names'])}" for r in missing))
    out = provinces.join(region_map, "province").select("region", "cell").distinct()
    empty = region_map.select("region").distinct().join(out.select("region").distinct(), "region", "left_anti").orderBy("region").collect()
    if empty:
        raise ValueError(f"regions without cells: {[r[0] for r in empty]}")
    return out.unionByName(out.select(F.lit(national).alias("region"), "cell").distinct()) if national else out


def missing_names(provinces: DataFrame, region_map: DataFrame) -> DataFrame:
    return region_map.join(provinces.select("province").distinct(), "province", "left_anti").select("region", "province")


def cut_out(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows within the mask: first its bounding box (a range that scans can skip by), then the cells themselves."""
    box = mask.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if box["r0"] is None:
        return df.limit(0)
    return df.where(F.col("row").between(box["r0"], box["r1"]) & F.col("col").between(box["c0"], box["c1"])).join(mask.select("cell"), "cell", "left_semi")


def merge_layers(parts: list[DataFrame]) -> DataFrame:
    """(cell, value): of each cell the first part's value that isn't missing."""
    union = None
    for i, p in enumerate(parts):
        one = p.select("cell", F.col("value").cast("double").alias("value"), F.lit(i).alias("part")).where(present(F.col("value")))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("cell").agg(F.min_by("value", "part").alias("value"))


def resample_nearest(target: DataFrame, grid: Grid, source: DataFrame, from_grid: Grid) -> DataFrame:
    """(cell, value): for each target cell the value of the source cell that holds its centre; null outside."""
    x = F.lit(grid.x0) + (F.col("col") - 0.5) * grid.dx
    y = F.lit(grid.y0) + (F.col("row") - 0.5) * grid.dy
    r, c = F.floor((y - from_grid.y0) / from_grid.dy) + 1, F.floor((x - from_grid.x0) / from_grid.dx) + 1
    at = target.select("cell", F.when(inside(r, c, from_grid.rows, from_grid.cols), cell_of(r, c, from_grid.cols)).alias("source"))
    return at.join(source.select(F.col("cell").alias("source"), "value"), "source", "left").select("cell", "value")


def resample_bilinear(target: DataFrame, grid: Grid, source: DataFrame, from_grid: Grid) -> DataFrame:
    """(cell, value): the four source cells around each target cell's centre, weighted by how near they are; cells
    without a value, or outside, don't count; null where none does. One join and aggregate."""
    u = (F.lit(grid.x0) + (F.col("col") - 0.5) * grid.dx - from_grid.x0) / from_grid.dx - 0.5
    v = (F.lit(grid.y0) + (F.col("row") - 0.5) * grid.dy - from_grid.y0) / from_grid.dy - 0.5
    near = lambda x, step: (F.floor(x) + 1 + step, x - F.floor(x) if step else 1 - (x - F.floor(x)))
    around = []
    for a in (0, 1):
        for b in (0, 1):
            (r, wr), (c, wc) = near(v, a), near(u, b)
            around.append(F.struct(F.when(inside(r, c, from_grid.rows, from_grid.cols), cell_of(r, c, from_grid.cols)).alias("source"), (wr * wc).alias("weight")))
    at = target.select("cell", F.inline(F.array(*around)))
    known = source.where(present(F.col("value"))).select(F.col("cell").alias("source"), F.col("value").cast("double").alias("value"))
    met = at.join(known, "source", "left").groupBy("cell")
    weight = F.sum(F.when(F.col("value").isNotNull(), F.col("weight")))
    return met.agg(F.when(weight > 0, F.sum(F.col("value") * F.col("weight")) / weight).alias("value"))


RESAMPLING = {"near": resample_nearest, "bilinear": resample_bilinear}


def polygon_cells(polygons: DataFrame, grid: Grid, name: str = "name", wkt: str = "wkt") -> DataFrame:
    """(name, cell) of the cells whose centres lie within a polygon, from POLYGON or MULTIPOLYGON texts.

    Every line of centres is cut by the edges that cross it; between odd and even cuts lies the inside, so holes and
    parts need no telling apart. Edges are dealt to the rows they cross, and a row of a polygon is one small group.
    Names may repeat (their polygons count together); null and empty texts have no cell.
    """
    number = lambda point, i: F.element_at(F.split(F.trim(point), r"\s+"), i).cast("double")
    one = lambda point: F.struct(((number(point, 1) - grid.x0) / grid.dx).alias("u"), ((number(point, 2) - grid.y0) / grid.dy).alias("v"))
    each = polygons.select(F.col(name).alias("name"), F.col(wkt).alias("wkt"), F.monotonically_increasing_id().alias("of"))
    rings = each.select("name", "of", F.explode(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("ring"))
    points = rings.select("name", "of", F.transform(F.split("ring", ","), one).alias("p"))
    ends = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edge = points.where(F.size("p") > 1).select("name", "of", F.explode(ends).alias("e")).select("name", "of", "e.a.u", "e.a.v", F.col("e.b.u").alias("u2"), F.col("e.b.v").alias("v2"))
    first, last = F.greatest(F.lit(1), F.ceil(F.least("v", "v2") + 0.5)), F.least(F.lit(grid.rows), F.ceil(F.greatest("v", "v2") + 0.5) - 1)
    rows = edge.withColumns({"first": first, "last": last}).where("first <= last").select("*", F.explode(F.sequence("first", "last")).alias("row"))
    cut_at = F.col("u") + (F.col("row") - 0.5 - F.col("v")) * (F.col("u2") - F.col("u")) / (F.col("v2") - F.col("v"))
    cuts = rows.groupBy("name", "of", "row").agg(F.sort_array(F.collect_list(cut_at)).alias("cuts"))
    spans = F.transform(F.sequence(F.lit(1), F.floor(F.size("cuts") / 2).cast("int")), lambda k: F.struct(F.greatest(F.lit(1), F.ceil(F.element_at("cuts", 2 * k - 1) + 0.5)).alias("a"), F.least(F.lit(grid.cols), F.ceil(F.element_at("cuts", 2 * k) + 0.5) - 1).alias("b")))
    within = cuts.where(F.size("cuts") > 1).select("name", "row", F.explode(spans).alias("s")).where("s.a <= s.b")
    return within.select("name", "row", F.explode(F.sequence("s.a", "s.b")).alias("col")).select("name", cell_of(F.col("row"), F.col("col"), grid.cols).alias("cell")).distinct()


# The grid that tests and queries use: one cell an order, 100 columns.
FIXTURE_COLS = 100


def fixture_grid(spark: SparkSession, folder: str) -> tuple[DataFrame, Grid]:
    """(cell, row, col, gdp, pop, ndvi, mndwi, band, region_name) from the star schema, with structural gaps."""
    orders = table(spark, folder, "orders").select((F.col("o_orderkey") + 1).alias("cell"), "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("gdp"))
    items = table(spark, folder, "lineitem").select((F.col("l_orderkey") + 1).alias("cell"), "l_quantity", "l_discount", "l_returnflag")
    sums = items.groupBy("cell").agg(F.sum("l_quantity").alias("pop"), F.avg(F.when(F.col("l_returnflag") != "N", F.col("l_discount"))).alias("mndwi"))
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("ndvi"), "c_nationkey")
    named = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("province"), F.col("r_name").alias("region_name"))
    out = orders.join(sums, "cell", "left").join(customer, "o_custkey", "left").join(named, "c_nationkey", "left")
    row, col = row_of(F.col("cell"), FIXTURE_COLS), col_of(F.col("cell"), FIXTURE_COLS)
    size = table(spark, folder, "orders").agg(F.max("o_orderkey").alias("m")).first()["m"] + 1
    grid = Grid(-(-size // FIXTURE_COLS), FIXTURE_COLS)
    return out.select("cell", row.alias("row"), col.alias("col"), *LAYERS, F.floor((row - 1) / 30).cast("bigint").alias("band"), "province", "region_name"), grid
