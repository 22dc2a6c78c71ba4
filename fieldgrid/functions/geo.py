"""Distances and polygon arithmetic as column expressions.

A polygon is an array of directed edges ``struct(x1, y1, x2, y2)``.  All rings of a region (parts and holes) are
in the same array: counting crossings with the even-odd rule needs no further structure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on the mean-radius sphere (within 0.6 % of the ellipsoid)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


# Semi-major axis and flattening of the WGS 84 ellipsoid.
_MAJOR_M, _FLATTENING = 6378137.0, 1 / 298.257223563
_ROUNDS = 20  # of the inverse iteration


def ellipsoid_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres along the geodesic of the ellipsoid, by Vincenty's inverse iteration.

    A fixed number of rounds; lines that have settled stop changing, to less than a millimetre, after a few.  Near
    antipodes the iteration need not settle: where the last two rounds differ by more than 1e-9 the result is NULL.
    Longitudes may differ by more than a turn; equal points are 0 apart.
    """
    f, b = F.lit(_FLATTENING), F.lit(_MAJOR_M * (1 - _FLATTENING))
    turn = lambda d: d - F.lit(360.0) * F.floor((d + F.lit(180.0)) / F.lit(360.0))
    along = F.radians(turn(lon2 - lon1))
    u1, u2 = (F.atan((1 - f) * F.tan(F.radians(lat))) for lat in (lat1, lat2))
    fixed = F.struct(along.alias("l"), F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"), F.cos(u2).alias("cu2"))

    def angles(x: Column, lam: Column) -> dict[str, Column]:
        """Of the arc on the auxiliary sphere for a difference of longitude there."""
        sin_s = F.sqrt(F.pow(x["cu2"] * F.sin(lam), 2) + F.pow(x["cu1"] * x["su2"] - x["su1"] * x["cu2"] * F.cos(lam), 2))
        cos_s = x["su1"] * x["su2"] + x["cu1"] * x["cu2"] * F.cos(lam)
        sin_a = F.when(sin_s > 0, x["cu1"] * x["cu2"] * F.sin(lam) / F.nullif(sin_s, F.lit(0.0))).otherwise(0.0)
        return {"sin_s": sin_s, "cos_s": cos_s, "sin_a": sin_a}

    def middle(x: Column, a: Column) -> Column:
        """Cosine of twice the angle to the middle of the line; 0 on the equator."""
        cos2_a = 1 - a["sin_a"] * a["sin_a"]
        return F.when(cos2_a > 1e-15, a["cos_s"] - 2 * x["su1"] * x["su2"] / F.nullif(cos2_a, F.lit(0.0))).otherwise(0.0)

    def step(acc: Column, x: Column) -> Column:
        # Each value becomes a field before the next one needs it, so expressions do not multiply.
        one = lambda s, fn: F.transform(F.array(s), fn)[0]
        arc = one(F.struct(acc["lam"].alias("lam")), lambda s: F.struct(s["lam"].alias("lam"), *[c.alias(n) for n, c in angles(x, s["lam"]).items()]))

        def ahead(s: Column) -> Column:
            cos2_a, m, sigma = 1 - s["sin_a"] * s["sin_a"], middle(x, s), F.atan2(s["sin_s"], s["cos_s"])
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = x["l"] + (1 - c) * f * s["sin_a"] * (sigma + c * s["sin_s"] * (m + c * s["cos_s"] * (2 * m * m - 1)))
            return F.struct(new.alias("lam"), s["lam"].alias("before"))

        return one(arc, ahead)

    def length(acc: Column, x: Column) -> Column:
        one = lambda s, fn: F.transform(F.array(s), fn)[0]
        arc = one(acc, lambda s: F.struct(s["lam"].alias("lam"), s["before"].alias("before"), *[c.alias(n) for n, c in angles(x, s["lam"]).items()]))

        def metres(s: Column) -> Column:
            ratio = F.lit((_MAJOR_M / (_MAJOR_M * (1 - _FLATTENING))) ** 2 - 1)
            u = (1 - s["sin_a"] * s["sin_a"]) * ratio
            m = middle(x, s)
            big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            bend = big_b * s["sin_s"] * (
                m + big_b / 4 * (s["cos_s"] * (2 * m * m - 1) - big_b / 6 * m * (4 * s["sin_s"] * s["sin_s"] - 3) * (4 * m * m - 3))
            )
            return F.when(F.abs(s["lam"] - s["before"]) <= 1e-9, b * big_a * (F.atan2(s["sin_s"], s["cos_s"]) - bend))

        return one(arc, metres)

    def solve(x: Column) -> Column:
        start = F.struct(x["l"].alias("lam"), (x["l"] + 1).alias("before"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, lambda acc, _: step(acc, x), lambda acc: length(acc, x))
        return F.when((x["l"] == 0) & (x["su1"] == x["su2"]), 0.0).otherwise(found)

    return F.transform(F.array(fixed), solve)[0]


def on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (cross == 0)
        & (x >= F.least(e["x1"], e["x2"]))
        & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"]))
        & (y <= F.greatest(e["y1"], e["y2"]))
    )


def _crosses(e: Column, x: Column, y: Column) -> Column:
    spans = (e["y1"] > y) != (e["y2"] > y)
    # The divisor is non-zero whenever the edge spans y; NULLIF keeps ANSI mode quiet for the rest.
    at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    return spans & (x < at)


def point_in_edges(edges: Column, x: Column, y: Column, boundary: bool = True) -> Column:
    """Even-odd ray casting.  ``boundary=True`` counts the outline as inside (intersects); ``False`` excludes it."""
    odd = (F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2) == 1
    outline = F.exists(edges, lambda e: on_edge(e, x, y))
    return (odd | outline) if boundary else (odd & ~outline)


def ring_edges(ring: Column) -> Column:
    """Edges of a closed ring given as ``array<struct<x, y>>``; the closing point may be left out."""
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(ring, i)["x"].alias("x1"),
            F.get(ring, i)["y"].alias("y1"),
            F.get(ring, (i + 1) % n)["x"].alias("x2"),
            F.get(ring, (i + 1) % n)["y"].alias("y2"),
        ),
    )


def _sum_edges(edges: Column, fn) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + fn(e))


def signed_area(edges: Column) -> Column:
    """Shoelace area in square degrees; holes must run opposite to their shell."""
    return _sum_edges(edges, lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def spherical_area_km2(edges: Column) -> Column:
    """Area on the sphere by the line-integral form of the shoelace rule."""
    total = _sum_edges(
        edges,
        lambda e: F.radians(e["x2"] - e["x1"]) * (F.lit(2.0) + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))),
    )
    return F.abs(total) * F.lit(EARTH_KM * EARTH_KM / 2.0)


def centroid(edges: Column) -> Column:
    """Area centroid as ``struct(x, y)``."""

    def weighted(axis: str) -> Column:
        return _sum_edges(
            edges, lambda e: (e[f"{axis}1"] + e[f"{axis}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])
        )

    six_area = F.nullif(signed_area(edges) * 6, F.lit(0.0))
    return F.struct((weighted("x") / six_area).alias("x"), (weighted("y") / six_area).alias("y"))


def bounding_box(edges: Column) -> Column:
    def axis(name: str) -> Column:
        return F.transform(edges, lambda e: e[name])

    return F.struct(
        F.array_min(axis("x1")).alias("xmin"),
        F.array_max(axis("x1")).alias("xmax"),
        F.array_min(axis("y1")).alias("ymin"),
        F.array_max(axis("y1")).alias("ymax"),
    )
