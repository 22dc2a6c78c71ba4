"""Checks of layers brought to the target grid: all bands, filled gaps, weather ingest, the vegetation chain (D4, D5, D20, D23, G4, G16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as g
from ..plans import climatology, layers
from . import adapters as a
from .q_features import veg_sources
from .q_grid import _LINEAR, _SPLINE
from .registry import cte, query

# Raw bands of the fine grid: fixed mixes of two measures, with gaps that differ from band to band.
BIO = {f"bio_{i}": f"CASE WHEN (ix + 2 * iy + {i}) % 6 = 0 THEN NULL ELSE price / {i + 1} + \"wc2.1_30s_elev\" * {i} END" for i in range(len(layers.BIOCLIM))}
COVER = {
    n: f"CASE WHEN {'ix % 12 < 6' if n == 'bare' else f'(ix // 3 + iy // 3 + {i}) % 9 = 0'} THEN NULL ELSE \"wc2.1_30s_elev\" * {i + 1} / 4000 END"
    for i, n in enumerate(layers.LANDCOVER)
}


def bands(spark, d, mixes):
    plain = lambda sql: sql.replace('"wc2.1_30s_elev"', "`wc2.1_30s_elev`").replace("//", "div")
    return a.layers(spark, d).select("ix", "iy", *[F.expr(plain(e)).cast("double").alias(n) for n, e in mixes.items()])


cte("target_cells", "SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy FROM (SELECT unnest(range(max(p_partkey) // 200 + 1)) AS i FROM part), (SELECT unnest(range(5)) AS j)")
cte("bio_raw", "SELECT ix, iy, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in BIO.items()) + " FROM layers")
cte("cover_raw", "SELECT ix, iy, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in COVER.items()) + " FROM layers")


def regrid_sql(source: str, columns: dict[str, str], kernel: str = _SPLINE, cells: str = "target_cells", at: str = "(t.{c} + 5e-1) * 2 - 5e-1", wide: float = 2.0, key: str = "") -> str:
    """Every target cell against every source cell; ``at`` is its place in source cells, ``wide`` the kernel's width in them."""
    k = [kernel.format(d=f"(({at.format(c=c)} - s.{c}) / {wide})") for c in ("ix", "iy")]
    means = ", ".join(f"sum(w * {old}) / nullif(sum(CASE WHEN {old} IS NOT NULL THEN w END), 0) AS {new}" for old, new in columns.items())
    head = f"{key}, " if key else ""
    return f"""SELECT {head}ix, iy, {means} FROM (SELECT t.ix, t.iy, s.* EXCLUDE (ix, iy), ({k[0]}) * ({k[1]}) AS w FROM {cells} t, {source} s) WHERE w > 0 GROUP BY {head}ix, iy"""


@query("D23_bioclim_on_the_target_grid", regrid_sql("bio_raw", dict(zip(BIO, layers.BIOCLIM))), " ".join(layers.BIOCLIM))
def _(spark, d):
    """All 19 bands, renamed by position, from the fine grid to the target grid."""
    spec = a.grid_spec(spark, d)
    return layers.bioclim_layer(bands(spark, d, BIO), a.fine_spec(spec), spec)


_OTHERS = [n for n in layers.LANDCOVER if n != "bare"]


@query(
    "G16_landcover_on_the_target_grid",
    f"""WITH r AS ({regrid_sql("cover_raw", {n: n for n in COVER})}) SELECT ix, iy, {", ".join(layers.LANDCOVER)} FROM r WHERE {" AND ".join(f"{n} IS NOT NULL" for n in layers.LANDCOVER)}
    UNION ALL SELECT ix, iy, {", ".join(f"1 - ({' + '.join(f'coalesce({o}, 0)' for o in _OTHERS)})" if n == "bare" else f"coalesce({n}, 0)" for n in layers.LANDCOVER)} FROM r WHERE bare IS NULL""",
    " ".join(layers.LANDCOVER),
)
def _(spark, d):
    """All 11 fractions on the target grid, then the rule for gaps."""
    spec = a.grid_spec(spark, d)
    placed = layers.static_layer(bands(spark, d, COVER), layers.LANDCOVER, a.fine_spec(spec), spec)
    return layers.fill_landcover(placed).select("ix", "iy", *layers.LANDCOVER)


cte(
    "bio_filled",
    """SELECT c.ix, c.iy, coalesce(s.bio_3, (SELECT avg(n.bio_3) FROM bio_raw n WHERE abs(n.ix - c.ix) <= 1 AND abs(n.iy - c.iy) <= 1)) AS bio_3
    FROM fine_grid c LEFT JOIN bio_raw s ON s.ix = c.ix AND s.iy = c.iy""",
)


@query("G04_regrid_with_filled_gaps", regrid_sql("bio_filled", {"bio_3": "v"}), "v")
def _(spark, d):
    """Gaps of the fine grid take the mean of their neighbours, then the layer is resampled to the coarser one."""
    spec = a.grid_spec(spark, d)
    raw = bands(spark, d, {"v": BIO["bio_3"]})
    return g.regrid(raw, a.fine_spec(spec), spec, ["v"], fill_na=True)


EXTENT = (20.3, 23.0, -9.5, -7.6)
_IN = "{x} >= 203e-1 AND {x} <= 23 AND {y} >= -95e-1 AND {y} <= -76e-1"
_SRC = _IN.format(x="20 + (ix + 5e-1) * 5e-1", y="-10 + (iy + 5e-1) * 5e-1")
_DST = _IN.format(x="20 + (ix + 5e-1) * 25e-2", y="-10 + (iy + 5e-1) * 25e-2")
_INGEST = regrid_sql(
    f"(SELECT * FROM daily WHERE {_SRC})", {c: c for c in a.WEATHER}, _LINEAR, f"(SELECT * FROM fine_grid WHERE {_DST})", "(t.{c} + 5e-1) / 2 - 5e-1", 1.0, "date"
)


@query(
    "D20_ingest_weather",
    f"SELECT ix, iy, date, CAST(dayofyear(date) AS INT) AS doy, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year, {', '.join(a.WEATHER)} FROM ({_INGEST})",
    " ".join(a.WEATHER),
)
def _(spark, d):
    """Daily weather cut to an extent and brought to a grid twice as fine, a day at a time."""
    spec = a.grid_spec(spark, d)
    return layers.ingest_weather(a.daily(spark, d), spec, a.fine_spec(spec), EXTENT, a.WEATHER)


@query(
    "D05_vegetation_chain",
    """SELECT f.ix, f.iy, f.date, f.doy, f.month, f.year, f.ndvi - k.m AS anomaly_ndvi, CASE WHEN abs(k.s) > 1e-12 * abs(k.m) THEN (f.ndvi - k.m) / k.s END AS anomaly_scaled_ndvi
    FROM fused f LEFT JOIN (SELECT ix, iy, doy, avg(ndvi) AS m, stddev_samp(ndvi) AS s FROM fused GROUP BY 1, 2, 3) k ON k.ix = f.ix AND k.iy = f.iy AND k.doy = f.doy AND k.s IS NOT NULL""",
    "anomaly_ndvi anomaly_scaled_ndvi",
)
def _(spark, d):
    """Composites to days, both satellites fused and scaled, the climatology of that series, and its anomalies."""
    fused = climatology.fuse_sources(veg_sources(spark, d))
    clim = climatology.climatology(fused, ["ndvi"], require_sd=True)
    return climatology.anomalies(fused, clim, ["ndvi"], drop_null=False)
