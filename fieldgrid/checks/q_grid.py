"""Checks of the grid and polygon operators (ids G1..G16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import grid as g
from ..operators.regions import cell_regions, mask_to_regions, rasterize, region_shapes
from ..plans import layers
from . import adapters as a
from .q_features import BANDS
from .registry import cte, query


@query("G01_grid_cells", "SELECT ix, iy, x, y FROM grid", "x y")
def _(spark, d):
    return a.grid_spec(spark, d).cells(spark)


@query("G02_snap_points", "SELECT outbreak_id, ix, iy FROM outbreaks")
def _(spark, d):
    return a.grid_spec(spark, d).snap(a.outbreaks(spark, d)).select("outbreak_id", "ix", "iy")


@query("G03_crop", "SELECT d.*, g.x, g.y FROM daily d JOIN grid g USING (ix, iy) WHERE g.x > 21 AND g.x < 24 AND g.y > -95e-1 AND g.y < -8", " ".join([*a.WEATHER, "x", "y"]))
def _(spark, d):
    return g.crop(a.grid_spec(spark, d).with_centres(a.daily(spark, d)), 21.0, 24.0, -9.5, -8.0)


def coarse_values(spark, d):
    """Mean price per target cell and part type; only small parts count, so many cells have NULL."""
    p = a.table(spark, d, "part")
    cell = [F.expr("cast(p_partkey div 200 as int)").alias("ix"), F.expr("cast(p_partkey % 5 as int)").alias("iy")]
    return p.groupBy(*cell, "p_type").agg(F.avg(F.when(F.col("p_size") < 6, F.col("p_retailprice"))).alias("v"))


cte(
    "coarse_values",
    "SELECT CAST(p_partkey // 200 AS INT) AS ix, CAST(p_partkey % 5 AS INT) AS iy, p_type, avg(CASE WHEN p_size < 6 THEN p_retailprice END) AS v FROM part GROUP BY 1, 2, 3",
)
cte("fine_grid", "SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy FROM (SELECT unnest(range((max(p_partkey) // 200 + 1) * 2)) AS i FROM part), (SELECT unnest(range(10)) AS j)")
_LINEAR = "greatest(0, 1 - abs({d}))"
_SPLINE = "CASE WHEN abs({d}) < 1 THEN (4 - 6 * pow({d}, 2) + 3 * pow(abs({d}), 3)) / 6 WHEN abs({d}) < 2 THEN pow(2 - abs({d}), 3) / 6 ELSE 0 END"


def _resample_sql(kernel: str, table: str, key: str = "") -> str:
    """Every target cell against every source cell with the kernel as a function of distance."""
    kx = kernel.format(d="((t.ix + 5e-1) / 2 - 5e-1 - s.ix)")
    ky = kernel.format(d="((t.iy + 5e-1) / 2 - 5e-1 - s.iy)")
    head = f"{key}, " if key else ""
    return f"""SELECT {head}ix, iy, sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS v
      FROM (SELECT {head}t.ix, t.iy, s.v, ({kx}) * ({ky}) AS w FROM fine_grid t, {table} s) WHERE w > 0 GROUP BY {head}ix, iy"""


@query("G04_resample_bilinear", _resample_sql(_LINEAR, "coarse_values", "p_type"), "v")
def _(spark, d):
    spec = a.grid_spec(spark, d)
    return g.resample(coarse_values(spark, d), spec, a.fine_spec(spec), ["v"], "bilinear", ["p_type"])


@query("G04_resample_cubicspline", _resample_sql(_SPLINE, "coarse_values", "p_type"), "v")
def _(spark, d):
    spec = a.grid_spec(spark, d)
    return g.resample(coarse_values(spark, d), spec, a.fine_spec(spec), ["v"], "cubicspline", ["p_type"])


def _coarser_sql(kernel: str, ratio: int) -> str:
    """As above for a target ``ratio`` times as coarse: the kernel is as much wider."""
    kx = kernel.format(d=f"(((t.ix + 5e-1) * {ratio} - 5e-1 - s.ix) / {ratio})")
    ky = kernel.format(d=f"(((t.iy + 5e-1) * {ratio} - 5e-1 - s.iy) / {ratio})")
    cells = f"SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy FROM (SELECT unnest(range(max(p_partkey) // 200 // {ratio} + 1)) AS i FROM part), (SELECT unnest(range(5 // {ratio} + 1)) AS j)"
    return f"""SELECT p_type, ix, iy, sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS v
      FROM (SELECT p_type, t.ix, t.iy, s.v, ({kx}) * ({ky}) AS w FROM ({cells}) t, coarse_values s) WHERE w > 0 GROUP BY p_type, ix, iy"""


def _coarser(spark, d, method, ratio):
    spec = a.grid_spec(spark, d)
    dst = g.GridSpec(spec.xmin, spec.ymin, spec.res * ratio, (spec.nx - 1) // ratio + 1, spec.ny // ratio + 1)
    return g.regrid(coarse_values(spark, d), spec, dst, ["v"], method, ["p_type"])


@query("G04_resample_bilinear_2_to_1", _coarser_sql(_LINEAR, 2), "v")
def _(spark, d):
    return _coarser(spark, d, "bilinear", 2)


@query("G04_resample_cubicspline_3_to_1", _coarser_sql(_SPLINE, 3), "v")
def _(spark, d):
    return _coarser(spark, d, "cubicspline", 3)


@query("G05_resample_near", "SELECT * FROM soil_target")
def _(spark, d):
    spec = a.grid_spec(spark, d)
    soil = layers.soil_classes(a.layers(spark, d), a.soil_key(spark, d))
    return g.resample_near(soil, a.fine_spec(spec), spec)


@query(
    "G06_resample_mode",
    """SELECT ix, iy, soil_texture FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY n DESC, soil_texture) AS rn FROM (
      SELECT CAST(ix // 2 AS INT) AS ix, CAST(iy // 2 AS INT) AS iy, soil_texture, count(*) AS n FROM soil GROUP BY ALL)) WHERE rn = 1""",
)
def _(spark, d):
    spec = a.grid_spec(spark, d)
    soil = layers.soil_classes(a.layers(spark, d), a.soil_key(spark, d))
    return g.resample_mode(soil, a.fine_spec(spec), spec, "soil_texture")


@query("G07_dominant_band", "SELECT ix, iy, CAST(aspect AS INT) AS aspect FROM top_band")
def _(spark, d):
    return a.layers(spark, d).select("ix", "iy", g.dominant_band(BANDS).alias("aspect"))


@query(
    "G08_focal_fill",
    """SELECT c.ix, c.iy, c.p_type, coalesce(c.v, (SELECT avg(n.v) FROM coarse_values n WHERE n.p_type = c.p_type AND abs(n.ix - c.ix) <= 1 AND abs(n.iy - c.iy) <= 1)) AS v FROM coarse_values c""",
    "v",
)
def _(spark, d):
    return g.focal_fill(coarse_values(spark, d), "v", ["p_type"])


cte(
    "filled_cases",
    """SELECT ix, iy, coalesce(v, (SELECT avg(n.m) FROM (SELECT ix, iy, avg(cases) AS m FROM outbreaks GROUP BY 1, 2) n WHERE abs(n.ix - q.ix) <= 1 AND abs(n.iy - q.iy) <= 1)) AS v
    FROM (SELECT g.ix, g.iy, o.v FROM grid g LEFT JOIN (SELECT ix, iy, avg(cases) AS v FROM outbreaks GROUP BY 1, 2) o USING (ix, iy)) q""",
)


@query("G09_grid_points", _resample_sql(_LINEAR, "filled_cases"), "v")
def _(spark, d):
    spec = a.grid_spec(spark, d)
    points = a.outbreaks(spark, d).withColumn("v", F.col("cases").cast("double"))
    return g.grid_points(points, spec, a.fine_spec(spec), "v", "longitude", "latitude", "bilinear")


@query("G10_rasterize", "SELECT DISTINCT ix, iy, x, y FROM cell_region", "x y")
def _(spark, d):
    return rasterize(a.regions(spark, d), a.grid_spec(spark, d))


@query("G10_cell_regions", "SELECT ix, iy, region FROM cell_region")
def _(spark, d):
    return cell_regions(a.regions(spark, d), a.grid_spec(spark, d))


@query(
    "G11_G13_region_shapes",
    """SELECT region, min(x1) AS xmin, max(x1) AS xmax, min(y1) AS ymin, max(y1) AS ymax,
      sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS centroid_x, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS centroid_y,
      abs(sum(x1 * y2 - x2 * y1)) / 2 AS area_deg2,
      abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 63710088e-4 * 63710088e-4 / 2 AS area FROM edges GROUP BY 1""",
    "xmin xmax ymin ymax centroid_x centroid_y area_deg2 area",
)
def _(spark, d):
    return region_shapes(a.regions(spark, d))


@query("G14_trim_region_columns", "SELECT d.ix, d.iy, d.date, r.region AS shapeName FROM daily d JOIN cell_region r USING (ix, iy)")
def _(spark, d):
    """Only the name column of the region table is kept."""
    shapes = a.regions(spark, d).withColumnRenamed("region", "shapeName").withColumn("shapeID", F.lit("n/a"))
    names = columns.columns_matching(shapes, "Name")
    rows = mask_to_regions(a.daily(spark, d).select("ix", "iy", "date"), shapes, a.grid_spec(spark, d), names[0])
    return rows.select("ix", "iy", "date", *names)


@query(
    "G15_box_tiles",
    """SELECT region, x_lo, CASE WHEN x_last AND x_hi - x_lo <= 2 THEN x_lo + 201e-2 ELSE x_hi END AS x_hi, y_lo, CASE WHEN y_last AND y_hi - y_lo <= 2 THEN y_lo + 201e-2 ELSE y_hi END AS y_hi
    FROM (SELECT region, xmin + 4 * i AS x_lo, least(xmin + 4 * (i + 1), xmax) AS x_hi, xmin + 4 * (i + 1) >= xmax AS x_last,
        ymin + 4 * j AS y_lo, least(ymin + 4 * (j + 1), ymax) AS y_hi, ymin + 4 * (j + 1) >= ymax AS y_last
      FROM (SELECT region, min(x1) * 3 - 50 AS xmin, max(x1) * 8 - 160 AS xmax, min(y1) AS ymin, max(y1) AS ymax FROM edges GROUP BY 1),
        (SELECT unnest(range(60)) AS i), (SELECT unnest(range(3)) AS j)
      WHERE xmin + 4 * i < xmax AND ymin + 4 * j < ymax AND xmin < xmax)""",
    "x_lo x_hi y_lo y_hi",
)
def _(spark, d):
    b = F.col("bbox")
    boxes = a.regions(spark, d).select("region", (b["xmin"] * 3 - 50).alias("xmin"), (b["xmax"] * 8 - 160).alias("xmax"), b["ymin"].alias("ymin"), b["ymax"].alias("ymax"))
    return g.box_tiles(boxes)


cte("cover", "SELECT ix, iy, economy / 40e0 AS trees, small / 40e0 AS shrubs, medium / 40e0 AS bare FROM layers")


@query(
    "G16_landcover_gap",
    """SELECT ix, iy, trees, shrubs, bare FROM cover WHERE trees IS NOT NULL AND shrubs IS NOT NULL AND bare IS NOT NULL
    UNION ALL SELECT ix, iy, coalesce(trees, 0), coalesce(shrubs, 0), 1 - (coalesce(trees, 0) + coalesce(shrubs, 0)) FROM cover WHERE bare IS NULL""",
    "trees shrubs bare",
)
def _(spark, d):
    pairs = (("economy", "trees"), ("small", "shrubs"), ("medium", "bare"))
    cover = a.layers(spark, d).select("ix", "iy", *[(F.col(c) / 40.0).alias(n) for c, n in pairs])
    return layers.fill_landcover(cover, ["trees", "shrubs", "bare"])
