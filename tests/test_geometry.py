"""Scanline cells against the edge test, and distances on the ellipsoid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import geo
from fieldgrid.operators import regions
from fieldgrid.operators.grid import GridSpec


def shapes(spark, rings):
    rows = [(name, [(float(x), float(y)) for x, y in ring]) for name, ring in rings]
    return regions.regions_from_rings(spark.createDataFrame(rows, "region string, ring array<struct<x: double, y: double>>"))


def star(rng, cx, cy, r, n):
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + rng.uniform(0.2, 1) * r * math.cos(t), cy + rng.uniform(0.2, 1) * r * math.sin(t)) for t in turn]


@pytest.mark.parametrize("boundary", [True, False])
def test_scanline_equals_the_edge_test_of_every_cell(spark, boundary):
    rng = random.Random(3)
    grid = GridSpec(-3.0, -2.0, 0.25, 40, 30)
    rings = [(f"star{i}", star(rng, rng.uniform(-2, 6), rng.uniform(-1, 5), 3, 25)) for i in range(6)]
    rings += [("box", [(-1.125, 0.125), (2.875, 0.125), (2.875, 3.125), (-1.125, 3.125)]), ("box", [(0.125, 1.125), (1.125, 1.125), (1.125, 2.125), (0.125, 2.125)])]
    rings += [("diagonal", [(-2.875, -1.875), (1.125, 2.125), (-2.875, 2.125)]), ("outside", [(50, 50), (51, 50), (51, 51)]), ("around", [(-99, -99), (99, -99), (99, 99), (-99, 99)])]
    table = shapes(spark, rings)
    want = regions.match_points(grid.cells(spark), table, boundary=boundary).select("region", "ix", "iy")
    got = regions.cell_regions(table, grid, boundary=boundary).select("region", "ix", "iy")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scanline_of_a_hundred_thousand_edges(spark):
    n = 100_000
    ring = [((1 + 0.1 * math.sin(40 * t)) * 30 * math.cos(t), (1 + 0.1 * math.sin(40 * t)) * 30 * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    grid = GridSpec(-40.0, -40.0, 0.5, 160, 160)
    table = shapes(spark, [("coast", ring)])
    plan = regions.cell_runs(table, grid)._jdf.queryExecution().toString()
    assert "Join" not in plan
    cells = regions.cell_regions(table, grid)
    inside = {(r.ix, r.iy) for r in cells.collect()}
    area = len(inside) * 0.25
    assert abs(area - math.pi * 900 * (1 + 0.005)) < 0.01 * area
    for ix in range(0, 160, 7):
        for iy in range(0, 160, 7):
            x, y = -40 + (ix + 0.5) * 0.5, -40 + (iy + 0.5) * 0.5
            r = (1 + 0.1 * math.sin(40 * math.atan2(y, x))) * 30
            if abs(math.hypot(x, y) - r) > 0.01:
                assert ((ix, iy) in inside) == (math.hypot(x, y) < r)


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


LINES = [  # lon1, lat1, lon2, lat2, metres
    (dms(144, 25, 29.52440), dms(-37, 57, 3.72030), dms(143, 55, 35.38390), dms(-37, 39, 10.15610), 54972.271),
    (0.0, 0.0, 1.0, 0.0, 111319.4908),
    (20.0, 0.0, 20.0, 90.0, 10001965.7293),
    (179.5, 0.0, -179.5, 0.0, 111319.4908),
    (-0.5, 0.0, 360.5, 0.0, 111319.4908),
    (33.0, 7.0, 33.0, 7.0, 0.0),
    (10.0, 45.0, 10.0, 46.0, 111141.5477),
]


def test_distances_on_the_ellipsoid(spark):
    df = spark.createDataFrame([(i, *line) for i, line in enumerate(LINES)], "i int, a double, b double, c double, d double, m double")
    got = df.select("m", geo.ellipsoid_m(*[F.col(c) for c in "abcd"]).alias("v"), geo.ellipsoid_m(*[F.col(c) for c in "cdab"]).alias("w")).collect()
    for r in got:
        assert abs(r.v - r.m) < 1.1e-3 and abs(r.v - r.w) < 1e-6


def test_antipodes_have_no_distance_and_nulls_stay(spark):
    df = spark.createDataFrame([(0.0, 0.3, 179.8, -0.2), (0.0, None, 1.0, 1.0), (0.0, 1.0, 179.0, 1.0)], "a double, b double, c double, d double")
    got = [r.v for r in df.select(geo.ellipsoid_m(*[F.col(c) for c in "abcd"]).alias("v")).collect()]
    assert got[0] is None and got[1] is None and 1.96e7 < got[2] < 2e7
