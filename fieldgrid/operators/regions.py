"""Region polygons, point-in-polygon matching and region aggregates.

A regions table has one row per region with ``edges`` (see :mod:`fieldgrid.functions.geo`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.aggregates import spec_aggregates
from ..session import broadcast_if_small
from .grid import GridSpec

# A cell -> region row is two integers and a name (about 60 bytes), so this many rows stay near 100 MB.
MAX_BROADCAST_CELLS = 2_000_000
# Four doubles per edge: about 64 MB.
MAX_BROADCAST_EDGES = 2_000_000


def regions_from_rings(rings: DataFrame, region: str = "region", ring: str = "ring") -> DataFrame:
    """One row per ring (parts and holes) to one row per region with all its edges and its bounding box."""
    edges = rings.select(region, F.explode(geo.ring_edges(F.col(ring))).alias("e"))
    out = edges.groupBy(region).agg(F.collect_list("e").alias("edges"))
    return with_bbox(out)


def regions_from_edges(edges: DataFrame, region: str = "region") -> DataFrame:
    """Flat ``region, x1, y1, x2, y2`` rows to one row per region."""
    out = edges.groupBy(region).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    return with_bbox(out)


def with_bbox(regions: DataFrame) -> DataFrame:
    return regions.withColumn("bbox", geo.bounding_box(F.col("edges")))


def overall_bbox(regions: DataFrame) -> DataFrame:
    return regions.agg(
        F.min("bbox.xmin").alias("xmin"),
        F.max("bbox.xmax").alias("xmax"),
        F.min("bbox.ymin").alias("ymin"),
        F.max("bbox.ymax").alias("ymax"),
    )


def _tiled(regions: DataFrame, region: str, tile: float) -> DataFrame:
    """Regions cut by square tiles.  A tile keeps only the edges that can decide a point inside it: those that
    reach its rows and are not entirely to its left.  A country outline is not copied whole to every tile."""
    size = F.lit(float(tile))

    def span(lo: str, hi: str):
        return F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor(F.col(hi) / size).cast("int"))

    tiles = regions.withColumn("_tx", F.explode(span("bbox.xmin", "bbox.xmax"))).withColumn(
        "_ty", F.explode(span("bbox.ymin", "bbox.ymax"))
    )
    near = F.filter(
        F.col("edges"),
        lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("_ty") * size)
        & (F.least(e["y1"], e["y2"]) <= (F.col("_ty") + 1) * size)
        & (F.greatest(e["x1"], e["x2"]) >= F.col("_tx") * size),
    )
    return tiles.select(region, "_tx", "_ty", near.alias("_edges"), F.col("bbox").alias("_bbox")).where(F.size("_edges") > 0)


def match_points(
    points: DataFrame,
    regions: DataFrame,
    x: str = "x",
    y: str = "y",
    region: str = "region",
    boundary: bool = True,
    tile: float = 1.0,
) -> DataFrame:
    """Inner point-in-polygon join; a point in several regions gives several rows.

    An equi join on tiles, then the bounding box, then the exact test, all in the join condition.  The tiled
    outlines are broadcast when their counted edges allow, so the points stay where they are and a tile that
    holds a large share of them is no hot spot.
    """
    size = F.lit(float(tile))
    placed = points.withColumns(
        {"_tx": F.floor(F.col(x) / size).cast("int"), "_ty": F.floor(F.col(y) / size).cast("int")}
    )
    tiled = _tiled(regions, region, tile).withColumnsRenamed({"_tx": "_rx", "_ty": "_ry"})
    tiled = broadcast_if_small(tiled, MAX_BROADCAST_EDGES, F.size("_edges"))
    b = F.col("_bbox")
    rule = (
        (F.col("_tx") == F.col("_rx"))
        & (F.col("_ty") == F.col("_ry"))
        & (F.col(x) >= b["xmin"])
        & (F.col(x) <= b["xmax"])
        & (F.col(y) >= b["ymin"])
        & (F.col(y) <= b["ymax"])
        & geo.point_in_edges(F.col("_edges"), F.col(x), F.col(y), boundary)
    )
    return placed.join(tiled, rule, "inner").drop("_tx", "_ty", "_rx", "_ry", "_bbox", "_edges")


def _edge_rows(regions: DataFrame, grid: GridSpec, region: str) -> DataFrame:
    """``region, e, iy, _y``: every edge with the grid rows whose centre line it reaches; at most two rows too many."""
    edges = regions.select(region, F.explode("edges").alias("e"))
    near = lambda y: (y - F.lit(grid.ymin)) / F.lit(grid.res) - 0.5
    low = F.greatest(F.floor(near(F.least("e.y1", "e.y2"))), F.lit(0))
    high = F.least(F.ceil(near(F.greatest("e.y1", "e.y2"))), F.lit(grid.ny - 1))
    rows = edges.withColumns({"_lo": low.cast("int"), "_hi": high.cast("int")}).where("_lo <= _hi")
    return rows.select(region, "e", F.explode(F.sequence("_lo", "_hi")).alias("iy")).withColumn("_y", grid.y(F.col("iy")))


def cell_runs(regions: DataFrame, grid: GridSpec, region: str = "region") -> DataFrame:
    """``region, iy, first, last``: runs of cells of a row whose centres lie inside, by scanline.

    Each edge crosses the centre lines of some rows; sorted, the crossings of a row pair up to runs.  So the work is
    that of edges and the rows they span, and no cell is tested against an edge.  Centres on the outline are decided by
    the crossing rule, see :func:`outline_cells`.
    """
    e = F.col("e")
    at = e["x1"] + (F.col("_y") - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    crossing = _edge_rows(regions, grid, region).where((e["y1"] > F.col("_y")) != (e["y2"] > F.col("_y"))).withColumn("_at", at)
    # Columns whose centre is west of the crossing: a first guess, made exact by comparing the centres around it.
    guess = (F.floor((F.col("_at") - F.lit(grid.xmin)) / F.lit(grid.res) - 0.5) - 1).cast("long")
    west = F.col("_g") + sum((grid.x(F.col("_g") + k) < F.col("_at")).cast("long") for k in range(3))
    crossing = crossing.withColumn("_g", guess).select(region, "iy", F.greatest(F.least(west, F.lit(grid.nx)), F.lit(0)).cast("int").alias("_c"))
    sorted_ = crossing.groupBy(region, "iy").agg(F.sort_array(F.collect_list("_c"), asc=False).alias("_c"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("_c") - 1, F.lit(2)),
        lambda k: F.struct(F.coalesce(F.get("_c", k + 1), F.lit(0)).alias("first"), (F.get("_c", k) - 1).alias("last")),
    )
    return sorted_.select(region, "iy", F.inline(pairs)).where("first <= last")


def outline_cells(regions: DataFrame, grid: GridSpec, region: str = "region") -> DataFrame:
    """``region, ix, iy`` of the cells whose centre lies on an edge."""
    e = F.col("e")
    rows = _edge_rows(regions, grid, region).where((F.col("_y") >= F.least("e.y1", "e.y2")) & (F.col("_y") <= F.greatest("e.y1", "e.y2")))
    flat = e["y1"] == e["y2"]
    at = e["x1"] + (F.col("_y") - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    column = lambda x: F.floor((x - F.lit(grid.xmin)) / F.lit(grid.res) - 0.5)
    low = F.when(flat, column(F.least("e.x1", "e.x2"))).otherwise(column(at) - 1)
    high = F.when(flat, column(F.greatest("e.x1", "e.x2")) + 1).otherwise(column(at) + 2)
    spans = rows.withColumns({"_lo": F.greatest(low, F.lit(0)).cast("int"), "_hi": F.least(high, F.lit(grid.nx - 1)).cast("int")}).where("_lo <= _hi")
    cells = spans.withColumn("ix", F.explode(F.sequence("_lo", "_hi")))
    return cells.where(geo.on_edge(e, grid.x(F.col("ix")), F.col("_y"))).select(region, "ix", "iy").distinct()


def cell_regions(regions: DataFrame, grid: GridSpec, region: str = "region", boundary: bool = True) -> DataFrame:
    """``ix, iy, region`` for the cells of a grid whose centre lies in a region, by scanline; the test runs once per
    edge and row, not per cell, row of data or date.  ``boundary`` counts centres on the outline as inside."""
    runs = cell_runs(regions, grid, region)
    inside = runs.select(region, F.explode(F.sequence("first", "last")).alias("ix"), "iy")
    outline = outline_cells(regions, grid, region)
    found = inside.unionByName(outline).distinct() if boundary else inside.join(outline, [region, "ix", "iy"], "left_anti")
    return found.select("ix", "iy", region)


def mask_to_regions(
    df: DataFrame, regions: DataFrame, grid: GridSpec, region: str = "region", boundary: bool = True
) -> DataFrame:
    """Keep rows whose cell centre lies in a region and add the region name.

    ``df`` is read once.  The cell map is broadcast when its counted size allows, so masking is a narrow step.
    """
    lookup = broadcast_if_small(cell_regions(regions, grid, region, boundary), MAX_BROADCAST_CELLS)
    return df.join(lookup, ["ix", "iy"], "inner")


def rasterize(regions: DataFrame, grid: GridSpec, region: str = "region") -> DataFrame:
    """Cells whose centre is covered by any region."""
    return grid.with_centres(cell_regions(regions, grid, region).select("ix", "iy").distinct())


def region_shapes(regions: DataFrame, region: str = "region") -> DataFrame:
    """Bounding box, centroid, planar area and area on the sphere of each region."""
    c = geo.centroid(F.col("edges"))
    return regions.select(
        region,
        F.col("bbox.xmin").alias("xmin"),
        F.col("bbox.xmax").alias("xmax"),
        F.col("bbox.ymin").alias("ymin"),
        F.col("bbox.ymax").alias("ymax"),
        c["x"].alias("centroid_x"),
        c["y"].alias("centroid_y"),
        F.abs(geo.signed_area(F.col("edges"))).alias("area_deg2"),
        geo.spherical_area_km2(F.col("edges")).alias("area"),
    )


def check_spec(df: DataFrame, spec: Mapping[str, str | None]) -> None:
    """Raise when the spec names variables the data does not have."""
    unknown = [v for v in spec if v not in df.columns]
    if unknown:
        raise ValueError(f"the aggregation spec names columns that are not in the data: {', '.join(unknown)}")


def aggregate_by_region(
    df: DataFrame,
    regions: DataFrame,
    grid: GridSpec,
    spec: Mapping[str, str | None],
    region: str = "region",
    date=None,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Spec-driven aggregates per region and grouping variables, with the region's area.

    ``spec`` maps variable -> ``"SUM" | "AVG" | "MODE" | None``; ``None`` marks a grouping variable.  Coordinates
    in the spec are never group keys.  Points on the outline of the regions' common bounding box are left out.
    """
    spec = {v: fn for v, fn in spec.items() if v not in ("x", "y", "ix", "iy")}
    check_spec(df, spec)
    keys, aggregates = spec_aggregates(spec)
    if date is not None:
        df = df.where(F.col("date") == F.lit(date).cast("date"))
    rows = df.select("ix", "iy", *[c for c in spec], *extra_keys)
    box = overall_bbox(regions).select(F.struct("xmin", "xmax", "ymin", "ymax")).scalar()
    lookup = grid.with_centres(cell_regions(regions, grid, region)).withColumn("_b", box)
    b = F.col("_b")
    inside = (F.col("x") > b["xmin"]) & (F.col("x") < b["xmax"]) & (F.col("y") > b["ymin"]) & (F.col("y") < b["ymax"])
    lookup = broadcast_if_small(lookup.where(inside).select("ix", "iy", region), MAX_BROADCAST_CELLS)
    masked = rows.join(lookup, ["ix", "iy"], "inner")
    areas = regions.select(region, geo.spherical_area_km2(F.col("edges")).alias("area"))
    return masked.groupBy(region, *keys, *extra_keys).agg(*aggregates).join(areas, region, "left")
