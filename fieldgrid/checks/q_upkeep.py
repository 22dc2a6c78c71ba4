"""Checks of what keeps stored tables up to date, of sweeps and of distances on the ellipsoid (S10-S12, D4, W3, F14, J20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators.grid import GridSpec
from ..operators.nearest import cells_within
from ..operators.windows import covered_until
from ..plans import climatology
from ..sources.curve import write_along_curve
from ..sources.refresh import refresh
from ..sources.writers import write_parquet
from . import adapters as a
from .registry import cte, query


def vincenty_sql(source: str, keys: str, rounds: int = 20) -> str:
    """Metres between ``lon1, lat1`` and ``lon2, lat2`` of ``source``, one view a round; NULL where it does not settle."""
    f, b = "(1 / 298257223563e-9)", "(6378137 * (1 - 1 / 298257223563e-9))"
    turn = "(lon2 - lon1 - 360 * floor((lon2 - lon1 + 180) / 360))"
    views = [
        f"""a0 AS (SELECT {keys}, l, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, l AS lam, l + 1 AS prev
        FROM (SELECT {keys}, radians({turn}) AS l, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2 FROM ({source})))"""
    ]
    arc = """SELECT *, CASE WHEN c2a > 1e-15 THEN cs - 2 * su1 * su2 / c2a ELSE 0 END AS m FROM (SELECT *, 1 - sa * sa AS c2a FROM (
        SELECT *, CASE WHEN ss > 0 THEN cu1 * cu2 * sin(lam) / ss ELSE 0 END AS sa FROM (
        SELECT *, sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM {})))"""
    for n in range(1, rounds + 1):
        views.append(
            f"""a{n} AS (SELECT {keys}, l, su1, cu1, su2, cu2, l + (1 - c) * {f} * sa * (atan2(ss, cs) + c * ss * (m + c * cs * (2 * m * m - 1))) AS lam, lam AS prev
            FROM (SELECT *, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS c FROM ({arc.format(f"a{n - 1}")})))"""
        )
    return f"""WITH {", ".join(views)} SELECT {keys}, CASE WHEN l = 0 AND su1 = su2 THEN 0 WHEN abs(lam - prev) <= 1e-9 THEN {b} * ga * (atan2(ss, cs) -
        gb * ss * (m + gb / 4 * (cs * (2 * m * m - 1) - gb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) END AS metres
        FROM (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS ga, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS gb
        FROM (SELECT *, c2a * (pow(6378137 / {b}, 2) - 1) AS u FROM ({arc.format(f"a{rounds}")})))"""


@query("F14_ellipsoid_distance", vincenty_sql("SELECT outbreak_id, longitude AS lon1, latitude AS lat1, 25 AS lon2, -5 AS lat2 FROM outbreaks", "outbreak_id"), "metres")
def _(spark, d):
    return a.outbreaks(spark, d).select("outbreak_id", geo.ellipsoid_m(F.col("longitude"), F.col("latitude"), F.lit(25.0), F.lit(-5.0)).alias("metres"))


STRIP = GridSpec(-180.0, -20.0, 2.0, 180, 15)
_PLACES = "SELECT DISTINCT CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS longitude, latitude FROM (SELECT CAST(177 + outbreak_id % 7 AS DOUBLE) AS lon, CAST(floor(latitude) AS DOUBLE) AS latitude FROM outbreaks)"
_STRIP = "SELECT p.longitude, p.latitude, i.ix, j.iy, p.longitude AS lon1, p.latitude AS lat1, -180 + (i.ix + 5e-1) * 2 AS lon2, -20 + (j.iy + 5e-1) * 2 AS lat2 FROM ({}) p, (SELECT CAST(unnest(range(180)) AS INT) AS ix) i, (SELECT CAST(unnest(range(15)) AS INT) AS iy) j"


@query(
    "J20_cells_across_the_date_line",
    f"SELECT longitude, latitude, ix, iy, metres / 1000 AS km FROM ({vincenty_sql(_STRIP.format(_PLACES), 'longitude, latitude, ix, iy')}) WHERE metres <= 500000",
    "longitude latitude km",
)
def _(spark, d):
    """Cells on both sides of the 180th meridian within reach of points near it, on the ellipsoid."""
    lon = F.expr("cast(177 + outbreak_id % 7 as double)")
    lon = F.when(lon >= 180, lon - 360).otherwise(lon)
    places = a.outbreaks(spark, d).select(lon.alias("longitude"), F.floor("latitude").cast("double").alias("latitude")).distinct()
    return cells_within(places, STRIP, 500.0, ellipsoid=True).select("longitude", "latitude", "ix", "iy", "km")


cte("visits", "SELECT l_suppkey AS place, CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS end_date FROM lineitem")


def visits(spark, d):
    start = F.to_date("l_shipdate")
    return a.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("place"), start.alias("start_date"), F.date_add(start, F.col("l_quantity").cast("int")).alias("end_date"))


def _swept(within: str) -> str:
    part = f"PARTITION BY {within} " if within else ""
    return f"""SELECT *, greatest(start_date - covered_until - 1, 0) AS gap_days, greatest(least(end_date, covered_until) - start_date + 1, 0) AS overlap_days,
      coalesce(start_date - covered_until > 1, false) AS has_gap, covered_until IS NOT NULL AND least(end_date, covered_until) >= start_date AS has_overlap
      FROM (SELECT *, max(end_date) OVER ({part}ORDER BY start_date, end_date, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_until FROM visits)"""


def _days(df):
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast("long") for c in ("gap_days", "overlap_days")})


_KNOWN = "SELECT * REPLACE (CASE WHEN covered_until IS NULL THEN -1 ELSE gap_days END AS gap_days, CASE WHEN covered_until IS NULL THEN -1 ELSE overlap_days END AS overlap_days) FROM ({})"


@query("W03_overlaps_by_sweep", _KNOWN.format(_swept("place")))
def _(spark, d):
    """Overlaps with any earlier interval of the same place, nested ones included."""
    return _days(covered_until(visits(spark, d), within=["place"]))


@query("D03_overlaps_of_one_series", _KNOWN.format(_swept("")))
def _(spark, d):
    """The same without groups: one series over all rows, in ranges."""
    return _days(covered_until(visits(spark, d), tie=["place"]))


STATS = [x for c in a.WEATHER for x in (c, f"{c}_sd")]


@query("D04_climatology_from_moments", "SELECT * FROM clim", " ".join(STATS))
def _(spark, d):
    """Moments of all years but the last are stored, the last year is added, and the climatology is merged from both."""
    path, daily = f"{a.scratch(spark)}/moments", a.daily(spark, d)
    last = daily.agg(F.max(F.year("date"))).first()[0]
    for part in (daily.where(F.year("date") < last), daily.where(F.year("date") == last)):
        write_parquet(climatology.yearly_moments(part, a.WEATHER), path, ["year"])
    return climatology.climatology_from_moments(spark.read.parquet(path), a.WEATHER)


BOX = "ix BETWEEN 1 AND 4 AND iy BETWEEN 1 AND 3 AND date >= DATE '1996-01-01' AND date < DATE '1997-07-01'"


@query("S10_box_along_a_curve", f"SELECT ix, iy, date, temperature FROM daily WHERE {BOX}", "temperature")
def _(spark, d):
    path = write_along_curve(a.daily(spark, d).select("ix", "iy", "date", "temperature"), f"{a.scratch(spark)}/curve", 24)
    return spark.read.parquet(path).where(BOX)


_YEARLY = "SELECT ix, iy, CAST(year(date) AS INT) AS year, avg(temperature + CASE WHEN year(date) = 1995 THEN 1 ELSE 0 END) AS temperature, count(*) AS days, 1 AS built FROM daily GROUP BY 1, 2, 3"


@query("S11_refresh_by_content", _YEARLY, "temperature")
def _(spark, d):
    """A past year changes between two runs: that year alone is built again."""
    path = f"{a.scratch(spark)}/yearly"
    daily = a.daily(spark, d).select("ix", "iy", F.year("date").alias("year"), "date", "temperature")
    build = lambda rows: rows.groupBy("ix", "iy", "year").agg(F.avg("temperature").alias("temperature"), F.count(F.lit(1)).alias("days"))
    refresh(daily, build, path, ["year"])
    changed = daily.withColumn("temperature", F.col("temperature") + F.when(F.col("year") == 1995, 1).otherwise(0))
    out, built = refresh(changed, build, path, ["year"])
    return out.withColumn("built", F.lit(built))



