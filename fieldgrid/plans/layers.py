"""Static layers: soil, dominant classes, land cover and plain rasters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted, recode, row_sum
from ..functions.columns import split_complete
from ..functions.dates import with_date_parts
from ..operators.grid import GridSpec, crop, dominant_band, regrid, resample_mode, resample_near

# Texture classes folded to seven groups; every other known class becomes 0.
TEXTURE_GROUPS = {5: "1", 7: "2", 8: "3", 9: "4", 10: "5", 11: "6", 12: "7"}
# Names of the land cover fractions and of the 19 bioclimatic layers, in layer order.
LANDCOVER = ("trees", "grassland", "shrubs", "cropland", "built", "bare", "snow", "water", "wetland", "mangroves", "moss")
BIOCLIM = (
    "Annual_Mean_Temperature",
    "Mean_Diurnal_Range",
    "Isothermality",
    "Temperature_Seasonality",
    "Max_Temperature_of_Warmest_Month",
    "Min_Temperature_of_Coldest_Month",
    "Temperature_Annual_Range",
    "Mean_Temperature_of_Wettest_Quarter",
    "Mean_Temperature_of_Driest_Quarter",
    "Mean_Temperature_of_Warmest_Quarter",
    "Mean_Temperature_of_Coldest_Quarter",
    "Annual_Precipitation",
    "Precipitation_of_Wettest_Month",
    "Precipitation_of_Driest_Month",
    "Precipitation_Seasonality",
    "Precipitation_of_Wettest_Quarter",
    "Precipitation_of_Driest_Quarter",
    "Precipitation_of_Warmest_Quarter",
    "Precipitation_of_Coldest_Quarter",
)


def soil_classes(units: DataFrame, key: DataFrame, src: GridSpec | None = None, dst: GridSpec | None = None) -> DataFrame:
    """Soil map units per cell to drainage and texture classes; unknown classes become ``UNK``.

    ``units`` holds ``ix, iy, unit``; ``key`` holds ``unit, drainage, texture``.
    """
    if src is not None and dst is not None:
        units = resample_near(units, src, dst)
    joined = units.join(key, "unit", "left")
    return joined.select(
        "ix",
        "iy",
        F.coalesce("drainage", F.lit("UNK")).alias("soil_drainage"),
        recode(F.col("texture"), TEXTURE_GROUPS, default="0", missing="UNK").alias("soil_texture"),
    )


def dominant_class(layers: DataFrame, bands: Sequence[str], name: str, src: GridSpec | None = None, dst: GridSpec | None = None) -> DataFrame:
    """Band with the largest value per fine cell, then the most frequent band per target cell, as a string class."""
    classed = layers.select("ix", "iy", dominant_band(bands).alias(name))
    if src is not None and dst is not None:
        classed = resample_mode(classed, src, dst, name)
    return classed.select("ix", "iy", F.col(name).cast("string").alias(name))


def static_layer(
    layer: DataFrame,
    columns: Sequence[str] | Mapping[str, str],
    src: GridSpec | None = None,
    dst: GridSpec | None = None,
    method: str = "cubicspline",
    fill_na: bool = False,
) -> DataFrame:
    """Plain raster bands, optionally renamed, gap-filled and brought to the target grid, finer or coarser."""
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    out = layer.select("ix", "iy", *[quoted(old).alias(new) for old, new in names.items()])
    if src is not None and dst is not None:
        out = regrid(out, src, dst, list(names.values()), method, fill_na=fill_na)
    return out


def bioclim_layer(layer: DataFrame, src: GridSpec | None = None, dst: GridSpec | None = None) -> DataFrame:
    """The 19 bioclimatic bands, named by their position after ``ix, iy``."""
    bands = [c for c in layer.columns if c not in ("ix", "iy")]
    if len(bands) != len(BIOCLIM):
        raise ValueError(f"expected {len(BIOCLIM)} bands, got {len(bands)}")
    return static_layer(layer, dict(zip(bands, BIOCLIM)), src, dst)


def fill_landcover(df: DataFrame, bands: Sequence[str] = LANDCOVER, gap: str = "bare") -> DataFrame:
    """Rows missing the gap band get it as 1 minus the others and 0 for other NULLs; other incomplete rows go."""
    complete, incomplete = split_complete(df, bands)
    others = [b for b in bands if b != gap]
    fixed = incomplete.where(quoted(gap).isNull()).withColumns(
        {gap: F.lit(1.0) - row_sum(others)} | {b: F.coalesce(quoted(b), F.lit(0.0)) for b in others}
    )
    return complete.unionByName(fixed)


def ingest_weather(
    raw: DataFrame,
    src: GridSpec,
    dst: GridSpec,
    extent: tuple[float, float, float, float],
    columns: Sequence[str] = ("relative_humidity", "temperature", "precipitation"),
    method: str = "bilinear",
    fill_na: bool = False,
) -> DataFrame:
    """Daily values of cells of ``src`` brought to ``dst``, cut to ``extent`` (xmin, xmax, ymin, ymax), with date parts.

    Source cells outside the extent have no say in the cells inside.  All variables of a day are resampled together;
    each renormalises over the cells that have it.
    """
    inside = lambda df, grid: crop(grid.with_centres(df), *extent, strict=False).drop("x", "y")
    rows = inside(raw.select("ix", "iy", "date", *columns), src)
    placed = regrid(rows, src, dst, columns, method, ["date"], fill_na)
    return with_date_parts(inside(placed, dst)).select("ix", "iy", "date", "doy", "month", "year", *columns)


def clean_weather(raw: DataFrame) -> DataFrame:
    """Station download to daily rows: lower-case names, distinct, renamed coordinates, typed date parts."""
    out = raw.toDF(*[c.lower() for c in raw.columns]).distinct()
    out = out.withColumnsRenamed({"lon": "x", "lat": "y", "mm": "month", "dd": "day"})
    out = out.withColumns({c: F.col(c).cast("int") for c in ("year", "month", "day") if c in out.columns})
    out = out.withColumn("date", F.make_date("year", "month", "day"))
    out = with_date_parts(out, "date", ["doy"])
    renamed = {"rh2m": "relative_humidity", "t2m": "temperature", "prectotcorr": "precipitation"}
    return out.withColumnsRenamed({k: v for k, v in renamed.items() if k in out.columns}).drop("yyyymmdd")
