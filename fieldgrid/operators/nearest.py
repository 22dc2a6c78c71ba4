"""Nearest-cell filling on a grid, and the cells around point events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.geo import KM_PER_DEGREE, ellipsoid_m, haversine_km
from ..session import cut
from .grid import GridSpec


def nearest_donors(holes: DataFrame, donors: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Value of the nearest donor cell for each hole: ``keys, ix, iy, value``.

    Exact, ties broken by the lowest ``(ix, iy)``.  ``holes`` and ``donors`` hold one row per cell and key.

    The search is done by grid columns.  The nearest donor of a hole inside its own column or row bounds the
    radius r, so only columns within r can hold a nearer one; in each of those columns only the next donor above
    and the next below the hole's row matter.  A hole thus costs about 2r probes instead of all donors, and the
    ordered passes run over single grid lines.
    """
    keys = list(keys)
    donors = donors.select(*keys, "ix", "iy", quoted(value).alias("_v"))
    holes = holes.select(*keys, "ix", "iy")

    def neighbours(probes: DataFrame, along: str, across: str) -> DataFrame:
        """For each probe, the row positions of the donors next to it on its line: ``_prev`` and ``_next``."""
        marks = donors.select(*keys, along, across, F.col(across).alias("_d"), F.lit(False).alias("_probe"))
        asks = probes.select(*keys, along, across, F.lit(None).cast("int").alias("_d"), F.lit(True).alias("_probe"))
        line = Window.partitionBy(*keys, along).orderBy(across)
        both = marks.unionByName(asks)
        both = both.withColumns(
            {
                "_prev": F.max("_d").over(line.rangeBetween(Window.unboundedPreceding, 0)),
                "_next": F.min("_d").over(line.rangeBetween(0, Window.unboundedFollowing)),
            }
        )
        return both.where("_probe").drop("_d", "_probe")

    def gap(prev: str, nxt: str, at: str):
        return F.least(F.abs(F.col(at) - F.col(prev)), F.abs(F.col(nxt) - F.col(at)))

    in_column = neighbours(holes, "ix", "iy").withColumn("_r1", gap("_prev", "_next", "iy")).drop("_prev", "_next")
    in_row = neighbours(holes, "iy", "ix").withColumn("_r2", gap("_prev", "_next", "ix")).drop("_prev", "_next")
    extent = donors.groupBy(*keys).agg(F.min("ix").alias("_lo"), F.max("ix").alias("_hi"))
    bounded = in_column.join(in_row, [*keys, "ix", "iy"])
    if keys:
        bounded = bounded.join(extent, keys)
    else:
        box = extent.select(F.struct("_lo", "_hi")).scalar()
        bounded = bounded.withColumn("_b", box).withColumns({"_lo": F.col("_b._lo"), "_hi": F.col("_b._hi")}).drop("_b")
        bounded = bounded.where(F.col("_lo").isNotNull())
    # No donor on the hole's row or column: any donor column may hold the nearest one.
    radius = F.least("_r1", "_r2")
    lo = F.when(radius.isNotNull(), F.greatest(F.col("ix") - radius, F.col("_lo"))).otherwise(F.col("_lo"))
    hi = F.when(radius.isNotNull(), F.least(F.col("ix") + radius, F.col("_hi"))).otherwise(F.col("_hi"))
    wanted = bounded.withColumns({"_from": lo, "_to": hi}).where(F.col("_from") <= F.col("_to"))
    probes = wanted.select(
        *keys, F.col("ix").alias("_hx"), F.col("iy"), F.explode(F.sequence("_from", "_to")).alias("ix")
    )
    # Holes of one row share their probes of a column.
    around = neighbours(probes.select(*keys, "ix", "iy").distinct(), "ix", "iy")
    found = probes.join(around, [*keys, "ix", "iy"]).select(
        *keys,
        "_hx",
        F.col("iy").alias("_hy"),
        F.col("ix").alias("_dx"),
        F.explode(F.array("_prev", "_next")).alias("_dy"),
    )
    best = found.where(F.col("_dy").isNotNull()).groupBy(*keys, "_hx", "_hy").agg(
        F.min(
            F.struct(
                (F.pow(F.col("_dx") - F.col("_hx"), 2) + F.pow(F.col("_dy") - F.col("_hy"), 2)).alias("d2"),
                F.col("_dx").alias("ix"),
                F.col("_dy").alias("iy"),
            )
        ).alias("_b")
    )
    chosen = best.select(*keys, "_hx", "_hy", F.col("_b.ix").alias("ix"), F.col("_b.iy").alias("iy"))
    return chosen.join(donors, [*keys, "ix", "iy"]).select(
        *keys, F.col("_hx").alias("ix"), F.col("_hy").alias("iy"), F.col("_v").alias(value)
    )


def fill_nearest(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Replace NULLs by the value of the nearest cell that has one; each column is filled on its own.

    Values are taken as a property of the cell (and ``keys``): rows of one cell share the filled value.  A cell
    that already has a value on some row keeps the lowest one for its empty rows.

    ``df`` is reduced to one row per cell for all columns together and that small table is materialised; the
    search works on it, and one join brings the values back.
    """
    keys = list(keys)
    place = [*keys, "ix", "iy"]
    cells = cut(df.groupBy(*place).agg(*[F.min(quoted(c)).alias(c) for c in columns]))
    values = cells
    for c in columns:
        donors = cells.where(quoted(c).isNotNull()).select(*place, quoted(c).alias(c))
        holes = cells.where(quoted(c).isNull()).select(*place)
        found = nearest_donors(holes, donors, c, keys).withColumnRenamed(c, "_found")
        values = values.join(found, place, "left")
        values = values.withColumn(c, F.coalesce(quoted(c), F.col("_found"))).drop("_found")
    values = values.withColumnsRenamed({c: f"_fill_{i}" for i, c in enumerate(columns)})
    out = df.join(values, place, "left")
    out = out.withColumns({c: F.coalesce(quoted(c), F.col(f"_fill_{i}")) for i, c in enumerate(columns)})
    return out.select(*[quoted(c) for c in df.columns])


def cells_within(
    points: DataFrame,
    grid: GridSpec,
    within_km: float,
    lon: str = "longitude",
    lat: str = "latitude",
    name: str = "km",
    ellipsoid: bool = False,
) -> DataFrame:
    """Every grid cell whose centre lies within ``within_km`` of each point, with the distance.

    The cells around a point follow from arithmetic on the grid: rows within reach, then for each row the
    half-width of the circle, also across the 180th meridian.  No join is needed and work is proportional to the
    result.  Distances are on the mean sphere or, with ``ellipsoid``, along its geodesics (on the sphere where those are
    not defined, near antipodes).
    """
    # Sphere and ellipsoid differ by less than a hundredth; nothing is further than half a turn.
    reach = F.lit(min(within_km / KM_PER_DEGREE * (1.01 if ellipsoid else 1.0), 180.0))
    pad = 1

    def row_of(value):
        return F.floor((value - F.lit(grid.ymin)) / F.lit(grid.res)).cast("int")

    def col_of(value):
        return F.floor((value - F.lit(grid.xmin)) / F.lit(grid.res)).cast("int")

    rows = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns(
        {
            "_r0": F.greatest(row_of(F.col(lat) - reach) - pad, F.lit(0)),
            "_r1": F.least(row_of(F.col(lat) + reach) + pad, F.lit(grid.ny - 1)),
        }
    )
    rows = rows.where(F.col("_r0") <= F.col("_r1")).withColumn("iy", F.explode(F.sequence("_r0", "_r1"))).drop("_r0", "_r1")
    cy = grid.y(F.col("iy"))
    # Longitude half-width of the circle on this row, from the haversine formula solved for the longitude.
    half_angle = F.sin(F.radians(reach) / 2)
    dlat = F.sin(F.radians(cy - F.col(lat)) / 2)
    across = F.cos(F.radians(cy)) * F.cos(F.radians(F.col(lat)))
    left = F.greatest(F.lit(0.0), F.pow(half_angle, 2) - F.pow(dlat, 2)) / F.greatest(across, F.lit(1e-12))
    width = F.degrees(F.asin(F.least(F.lit(1.0), F.sqrt(left)))) * 2

    def columns_at(turn: float):
        """Columns in reach of the point a turn to the east."""
        first = F.greatest(col_of(F.greatest(F.col(lon) + turn - F.col("_w"), F.lit(-1e6))) - pad, F.lit(0))
        last = F.least(col_of(F.col(lon) + turn + F.col("_w")) + pad, F.lit(grid.nx - 1))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    reached = F.array_distinct(F.concat(*[columns_at(turn) for turn in (0.0, -360.0, 360.0)]))
    cells = rows.withColumn("_w", width).withColumn("ix", F.explode(reached)).drop("_w")
    ends = F.col(lon), F.col(lat), grid.x(F.col("ix")), grid.y(F.col("iy"))
    distance = F.coalesce(ellipsoid_m(*ends) / 1000, haversine_km(*ends)) if ellipsoid else haversine_km(*ends)
    return cells.withColumn(name, distance).where(F.col(name) <= F.lit(float(within_km)))
