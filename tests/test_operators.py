"""Operators on small hand-made frames: boundary days, missing values, ties, and brute-force comparisons."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import aggregates as agg
from fieldgrid.functions import columns, geo
from fieldgrid.operators import grid as g
from fieldgrid.operators import joins, nearest, ranks, regions, windows
from fieldgrid.plans import assemble, calendars, climatology, districts, events, folds, forecast, layers, modelling
from fieldgrid.sources import readers, validation, writers

D = dt.date


def days(start, n, step=1):
    return [start + dt.timedelta(days=i * step) for i in range(n)]


def date_frame(spark, dates):
    return spark.createDataFrame([(d,) for d in dates], "date date")


# --- climatology and anomalies --------------------------------------------------------------------------------


def series(spark, rows):
    return spark.createDataFrame(rows, "ix int, iy int, date date, v double")


def test_leap_day_is_its_own_group(spark):
    df = series(spark, [(0, 0, d, float(i)) for i, d in enumerate(days(D(2015, 12, 30), 370))])
    clim = climatology.climatology(df, ["v"])
    assert clim.where("doy = 366").select("v").collect()[0][0] == float((D(2016, 12, 31) - D(2015, 12, 30)).days)
    assert clim.where("doy = 1").count() == 1


def test_flat_series_gives_null_scaled_anomaly(spark):
    df = series(spark, [(0, 0, D(y, 3, 1), 5.0) for y in (2001, 2002, 2003)])
    for out in (
        climatology.anomalies(df, climatology.climatology(df, ["v"]), ["v"]),
        climatology.own_anomalies(df, ["v"]),
    ):
        got = out.select("anomaly_v", "anomaly_scaled_v").distinct().collect()
        assert [tuple(r) for r in got] == [(0.0, None)]


def test_single_observation(spark):
    df = series(spark, [(0, 0, D(2001, 3, 1), 5.0)])
    assert climatology.climatology(df, ["v"], require_sd=True).count() == 0
    assert climatology.own_anomalies(df, ["v"]).count() == 0  # weather form drops it
    kept = climatology.anomalies(df, climatology.climatology(df, ["v"], require_sd=True), ["v"], drop_null=False)
    assert kept.select("anomaly_v").collect()[0][0] is None  # vegetation form keeps the row


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 4.0)], "k int, v double")
    skip = {r.k: r.v for r in df.groupBy("k").agg(*agg.means(["v"])).collect()}
    poison = {r.k: r.v for r in df.groupBy("k").agg(*agg.means(["v"], na_rm=False)).collect()}
    assert skip == {1: 1.0, 2: 4.0} and poison == {1: None, 2: 4.0}
    none = spark.createDataFrame([(1, None)], "k int, v double").groupBy("k").agg(agg.total(F.col("v")).alias("v"))
    assert none.collect()[0].v == 0


def test_fused_sources_average_overlap_and_poison(spark):
    m = spark.createDataFrame([(0, 0, D(2018, 1, 1), 5000.0), (0, 0, D(2018, 1, 2), 5000.0)], "ix int, iy int, date date, ndvi double")
    s = spark.createDataFrame([(0, 0, D(2018, 1, 2), 60.0), (0, 0, D(2018, 1, 3), None)], "ix int, iy int, date date, ndvi double")
    out = {r.date.day: r.ndvi for r in climatology.fuse_sources({"modis": m, "sentinel": s}).collect()}
    assert out[1] == 0.5 and out[2] == pytest.approx(0.4) and out[3] is None


def test_composite_lookup_reports_gaps_and_overlaps(spark):
    primary = spark.createDataFrame([(D(2019, 1, 10), D(2019, 1, 22)), (D(2019, 1, 20), D(2019, 1, 29))], "start_date date, end_date date")
    fallback = spark.createDataFrame([(D(2018, 12, 19),), (D(2019, 1, 1),), (D(2019, 1, 17),)], "start_date date")
    lookup, problems = climatology.composite_date_lookup(primary, fallback)
    served = {(r.satellite, r.start_date): len(r.lookup_dates) for r in lookup.collect()}
    assert served == {
        ("modis", D(2018, 12, 19)): 13,
        ("modis", D(2019, 1, 1)): 9,
        ("sentinel", D(2019, 1, 10)): 10,
        ("sentinel", D(2019, 1, 20)): 10,
    }
    assert problems.count() == 0
    early = spark.createDataFrame([(D(2018, 12, 1),), (D(2018, 12, 17),)], "start_date date")
    _, problems = climatology.composite_date_lookup(primary, early)
    gaps = problems.collect()
    assert {r.problem for r in gaps} == {"missing"} and len(gaps) == (D(2019, 1, 10) - D(2018, 12, 17)).days


# --- lags -----------------------------------------------------------------------------------------------------


def test_interval_lags_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(c, 0, D(2020, 1, 1) + dt.timedelta(days=rnd.randrange(120)), rnd.choice([None, rnd.random()])) for c in (0, 1) for _ in range(80)]
    df = series(spark, rows)
    for name, fold in (("avg", lambda v: sum(v) / len(v)), ("sum", sum), ("max", max), ("count", len)):
        out = windows.interval_lags(df, ["v"], 30, 3, agg=name).collect()
        assert len(out) == len(rows)
        for r in out:
            for i in (1, 2, 3):
                lo, hi = r.date - dt.timedelta(days=30 * i), r.date - dt.timedelta(days=30 * (i - 1) + 1)
                values = [v for c, _, d, v in rows if c == r.ix and lo <= d <= hi and v is not None]
                want = (fold(values) if values else (0 if name == "count" else None))
                got = r[f"v_lag_{30 * i}"]
                assert (got is None) == (want is None) and (want is None or got == pytest.approx(want))


def test_interval_lags_rejects_unknown_column(spark):
    with pytest.raises(ValueError):
        windows.interval_lags(series(spark, [(0, 0, D(2020, 1, 1), 1.0)]), ["nope"])


def test_lag_means_fallback_and_dropped_dates(spark):
    dates = [D(2020, 1, 1), D(2020, 1, 6), D(2020, 1, 26), D(2020, 4, 30), D(2020, 5, 5)]
    rows = [(0, 0, d, float(i)) for i, d in enumerate(dates)] + [(1, 0, dates[2], None), (1, 0, dates[4], 7.0)]
    out = districts.lag_means_by_available_dates(series(spark, rows), ["v"])
    got = {(r.ix, r.date): (r.v_30, r.v_60, r.v_90) for r in out.collect()}
    # The first three dates have no sampled date before date - 61.
    assert set(got) == {(0, D(2020, 4, 30)), (0, D(2020, 5, 5)), (1, D(2020, 5, 5))}
    # 30 April: no sampled day in any bucket, so each takes the latest earlier day (26 January, value 2).
    assert got[(0, D(2020, 4, 30))] == (2.0, 2.0, 2.0)
    # 5 May: 30 April is in the first bucket; the others fall back to 26 January.
    assert got[(0, D(2020, 5, 5))] == (3.0, 2.0, 2.0)
    # Cell 1 has no row on 30 April (bucket not empty for the calendar) and a NULL on 26 January.
    assert got[(1, D(2020, 5, 5))] == (None, None, None)


# --- forecasts ------------------------------------------------------------------------------------------------


def test_forecast_anomaly_weights_months_by_days(spark):
    base = D(2020, 3, 1)
    fc = spark.createDataFrame(
        [(0, 0, base, 3, 2020, 10.0), (0, 0, base, 4, 2020, 40.0)], "ix int, iy int, base_date date, lead_month int, lead_year int, v double"
    ).withColumn("v_sd", F.lit(1.0))
    clim = spark.createDataFrame([(0, 0, d, 1.0, 2.0) for d in range(1, 367)], "ix int, iy int, doy int, v double, v_sd double")
    out = forecast.forecast_anomalies(fc, clim, date_frame(spark, [D(2020, 3, 20)]), (0, 30), ["v"]).collect()
    want = (12 * 10.0 + 18 * 40.0) / 30 - 1.0
    assert out[0].anomaly_forecast_v == pytest.approx(want)
    assert out[0].anomaly_forecast_scaled_v == pytest.approx(want / 2)
    assert out[0].forecast_interval == 30


def test_forecast_uses_days_that_have_a_climatology(spark):
    fc = spark.createDataFrame([(0, 0, D(2020, 3, 1), 3, 2020, 10.0), (0, 0, D(2020, 3, 1), 4, 2020, 40.0)], "ix int, iy int, base_date date, lead_month int, lead_year int, v double")
    clim = spark.createDataFrame([(0, 0, 80, 1.0, 2.0), (0, 0, 95, 3.0, 2.0)], "ix int, iy int, doy int, v double, v_sd double")
    out = forecast.forecast_anomalies(fc, clim, date_frame(spark, [D(2020, 3, 20)]), (0, 30), ["v"]).collect()
    assert out[0].anomaly_forecast_v == pytest.approx(25.0 - 2.0)


def test_latest_issue(spark):
    issues = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 2, 1),)], "base_date date")
    out = joins.latest_at_or_before(date_frame(spark, [D(2019, 12, 31), D(2020, 1, 1), D(2020, 1, 31), D(2020, 5, 1)]), issues)
    assert {(r.date, r.base_date) for r in out.collect()} == {
        (D(2020, 1, 1), D(2020, 1, 1)),
        (D(2020, 1, 31), D(2020, 1, 1)),
        (D(2020, 5, 1), D(2020, 2, 1)),
    }


def test_humidity_units(spark):
    rows = [(0, 0, D(2020, 1, 1), D(2020, 2, 1), v, u, x) for v, u, xs in (("temperature", "C", (293.15, 295.15)), ("dewpoint", "C", (283.15, 283.15)), ("precipitation", "", (-1e-8, 3e-8))) for x in xs]
    df = spark.createDataFrame(rows, "ix int, iy int, base_date date, forecast_end_date date, variable string, units string, value double")
    r = forecast.normalize_forecast(df).collect()[0]
    es = lambda t: math.exp(17.625 * t / (243.04 + t))
    assert r.temperature == pytest.approx(21.0) and r.lead_month == 1 and r.lead_year == 2020
    assert r.relative_humidity == pytest.approx(100 * es(10) / es(21))
    assert r.precipitation == pytest.approx(1e-8 * 8.64e7)
    slope = r.relative_humidity * 17.625 * 243.04 / (243.04 + 21) ** 2
    assert r.relative_humidity_sd == pytest.approx(slope * math.sqrt(2))


# --- events ---------------------------------------------------------------------------------------------------

GRID = g.GridSpec(0.0, 0.0, 1.0, 8, 8)


def outbreak_frame(spark, rows):
    return spark.createDataFrame(rows, "longitude double, latitude double, start_date date, cases int")


def test_response_half_open_edges(spark):
    day = D(2020, 1, 1)
    rows = [(0.5, 0.5, day + dt.timedelta(days=k), 1) for k in (0, 1, 29, 30, 149, 150)]
    out = events.outbreak_response(outbreak_frame(spark, rows), GRID, date_frame(spark, [day]))
    assert {r.forecast_interval: r.cases for r in out.collect()} == {30: 2.0, 60: 1.0, 150: 1.0}


def test_response_counts_null_cases_as_zero_and_skips_outside(spark):
    day = D(2020, 1, 1)
    rows = [(0.5, 0.5, day + dt.timedelta(days=5), None), (99.0, 0.5, day + dt.timedelta(days=5), 4)]
    out = events.outbreak_response(outbreak_frame(spark, rows), GRID, date_frame(spark, [day])).collect()
    assert [(r.ix, r.iy, r.cases) for r in out] == [(0, 0, 0.0)]


def _km(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(a)))


def test_outbreak_history_matches_definition(spark):
    day = D(2020, 6, 1)
    ages = [0, 1, 30, 91, 92, 200, 3650, 3652, 3653, 3700]
    rows = [(0.5 + 0.7 * i % 7, 0.5 + (i % 3), day - dt.timedelta(days=a), None if i % 4 == 0 else i) for i, a in enumerate(ages)]
    dates = [day, day - dt.timedelta(days=100)]
    out = events.outbreak_history(date_frame(spark, dates), outbreak_frame(spark, rows), GRID, within_km=300.0).collect()
    assert len(out) == GRID.nx * GRID.ny * 2
    for r in out:
        want = [0.0, 0.0]
        for lon, lat, start, cases in rows:
            years, km = (r.date - start).days / 365.25, _km(lon, lat, r.ix + 0.5, r.iy + 0.5)
            if (r.date - start).days > 0 and years < 10 and km <= 300:
                w = (1 if cases is None else math.log10(cases + 1)) * math.exp(-0.5 * years) * math.exp(-0.01 * km)
                want[0 if years < 0.25 else 1] += w
        assert r.outbreak_history_weight_recent == pytest.approx(want[0], abs=1e-9)
        assert r.outbreak_history_weight_old == pytest.approx(want[1], abs=1e-9)


@pytest.mark.parametrize("within", [50.0, 111.0, 400.0, 2000.0])
def test_cells_within_matches_brute_force(spark, within):
    spec = g.GridSpec(-3.0, 55.0, 0.7, 15, 15)
    pts = [(1, -2.9, 55.1), (2, 2.0, 60.3), (3, 9.0, 64.0), (4, 0.0, 70.0)]
    df = spark.createDataFrame(pts, "id int, longitude double, latitude double")
    got = {(r.id, r.ix, r.iy) for r in nearest.cells_within(df, spec, within).collect()}
    want = {
        (i, ix, iy)
        for i, lon, lat in pts
        for ix in range(15)
        for iy in range(15)
        if _km(lon, lat, -3.0 + (ix + 0.5) * 0.7, 55.0 + (iy + 0.5) * 0.7) <= within
    }
    assert got == want


def test_spread_labels(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), "1.0", "2.0"), ("a", D(2020, 1, 4), "1.0", "2.0"), ("b", D(2020, 1, 2), "1", None), ("c", D(2020, 1, 2), "1", "1")], "epi_event_id string, outbreak_start_date date, longitude string, latitude string")
    got = {(r.epi_event_id, r.days): (r.origin_loc, r.single_outbreak) for r in events.outbreak_spread(df).collect()}
    assert got == {("a", 0): (True, "Outbreak Origin"), ("a", 3): (False, "Outbreak Origin"), ("c", 0): (True, "Single Outbreak")}


# --- nearest neighbour ----------------------------------------------------------------------------------------


def brute_nearest(hole, donors):
    return min(donors, key=lambda d: ((d[0] - hole[0]) ** 2 + (d[1] - hole[1]) ** 2, d[0], d[1]))


@pytest.mark.parametrize("seed,n_donors", [(1, 1), (2, 5), (3, 30), (4, 90)])
def test_nearest_fill_matches_brute_force(spark, seed, n_donors):
    rnd = random.Random(seed)
    cells = [(x, y) for x in range(14) for y in range(11)]
    donors = set(rnd.sample(cells, n_donors))
    rows = [(x, y, f"v{x}_{y}" if (x, y) in donors else None) for x, y in cells if (x, y) in donors or rnd.random() < 0.7]
    out = nearest.fill_nearest(spark.createDataFrame(rows, "ix int, iy int, v string"), ["v"])
    got = {(r.ix, r.iy): r.v for r in out.collect()}
    for x, y, v in rows:
        bx, by = brute_nearest((x, y), donors)
        assert got[(x, y)] == (v or f"v{bx}_{by}")


def test_nearest_fill_without_shared_line_and_without_donor(spark):
    df = spark.createDataFrame([(0, 0, None), (5, 7, "a"), (9, 1, "b")], "ix int, iy int, v string")
    assert {(r.ix, r.iy): r.v for r in nearest.fill_nearest(df, ["v"]).collect()}[(0, 0)] == "a"
    empty = spark.createDataFrame([(0, 0, None)], "ix int, iy int, v string")
    assert nearest.fill_nearest(empty, ["v"]).collect()[0].v is None


def test_soil_ties_and_unknown(spark):
    df = spark.createDataFrame([(0, 1, "E", "1"), (1, 1, "UNK", "UNK"), (2, 1, "VP", "7"), (1, 0, "UNK", "3")], "ix int, iy int, soil_drainage string, soil_texture string")
    got = {(r.ix, r.iy): (r.soil_drainage, r.soil_texture) for r in districts.impute_soil(df).collect()}
    assert got[(1, 1)] == (1.0, 1.0)  # (0,1), (1,0) and (2,1) tie: lowest column, then row
    assert got[(1, 0)] == (1.0, 3.0)


# --- polygons -------------------------------------------------------------------------------------------------


def shape_frame(spark):
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    rows = [
        ("ell", ring([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)])),
        ("box", ring([(3, 0), (6, 0), (6, 3), (3, 3)])),
        ("box", ring([(4, 1), (4, 2), (5, 2), (5, 1)])),  # hole
    ]
    return regions.regions_from_rings(spark.createDataFrame(rows, "region string, ring array<struct<x double, y double>>"))


def test_points_inside_on_edge_in_hole_and_in_two(spark):
    pts = [("in", 0.5, 0.5), ("out", 2.0, 2.0), ("edge", 0.0, 2.0), ("vertex", 1.0, 1.0), ("hole", 4.5, 1.5), ("both", 3.5, 0.5), ("ring", 4.0, 1.5)]
    df = spark.createDataFrame(pts, "name string, x double, y double")
    shapes = shape_frame(spark)
    for tile in (0.5, 1.0, 7.0):
        got = {(r.name, r.region) for r in regions.match_points(df, shapes, tile=tile).collect()}
        assert got == {("in", "ell"), ("edge", "ell"), ("vertex", "ell"), ("both", "ell"), ("both", "box"), ("ring", "box")}
        inner = {(r.name, r.region) for r in regions.match_points(df, shapes, boundary=False, tile=tile).collect()}
        assert inner == {("in", "ell"), ("both", "ell"), ("both", "box")}


def test_shapes(spark):
    r = {x.region: x for x in regions.region_shapes(shape_frame(spark)).collect()}
    assert r["ell"].area_deg2 == pytest.approx(7.0) and r["box"].area_deg2 == pytest.approx(8.0)
    assert (r["box"].centroid_x, r["box"].centroid_y) == pytest.approx((4.5, 1.5))
    assert r["ell"].area == pytest.approx(7.0 * geo.KM_PER_DEGREE**2, rel=2e-3)


def test_spec_is_checked(spark):
    with pytest.raises(ValueError):
        regions.aggregate_by_region(series(spark, [(0, 0, D(2020, 1, 1), 1.0)]), shape_frame(spark), GRID, {"nope": "AVG"})


def test_spec_aggregates_on_nulls_and_ties(spark):
    """A missing weight, a tie of kinds, and one place with a single row."""
    rows = [("north", 1.5, 7, 3), ("north", None, 2, 9), ("north", 4.5, 1, 9), ("north", 3.0, 5, 3), ("south", 8.25, 4, 1)]
    df = spark.createDataFrame(rows, "place string, weight double, visits int, kind int")
    keys, aggs = agg.spec_aggregates({"place": None, "weight": "mean", "visits": "sum", "kind": "mode"})
    got = {r.place: (r.weight_avg, r.visits_sum, r.kind_mode) for r in df.groupBy(*keys).agg(*aggs).collect()}
    assert got == {"north": (3.0, 15, 3), "south": (8.25, 4, 1)}


# --- grids ----------------------------------------------------------------------------------------------------


def test_snap_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (8.0, 8.0), (8.1, 1.0), (-0.1, 1.0), (1.0, 7.999)], "longitude double, latitude double")
    got = [(r.ix, r.iy) for r in GRID.snap(df).collect()]
    assert got == [(0, 0), (7, 7), (None, None), (None, None), (1, 7)]


def test_snap_lines_between_cells_and_odd_coordinates(spark):
    spec = g.GridSpec(20.0, -10.0, 0.5, 6, 5)
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(20.5, -9.5), (21.0, -8.0), (20.2, -7.5), (20.2, -10.0), (nan, -9.0), (21.0, nan), (3e12, -9.0), (21.0, -3e12), (inf, -9.0), (None, -9.0)], "longitude double, latitude double")
    got = [(r.ix, r.iy) for r in spec.snap(df).collect()]
    assert got == [(1, 0), (2, 3), (0, 4), (0, 0)] + [(None, None)] * 6
    tenth = g.GridSpec(0.0, 0.0, 0.1, 40, 40)
    lines = spark.createDataFrame([(round(0.1 * k, 1), round(4.0 - 0.1 * k, 1), k) for k in range(1, 40)], "longitude double, latitude double, k int")
    for r in tenth.snap(lines).collect():  # divided from the west and from the north, as given
        assert (r.ix, 39 - r.iy) == (math.floor((r.longitude - 0.0) / 0.1), math.floor((4.0 - r.latitude) / 0.1))


@pytest.mark.parametrize(("method", "ratio"), [("bilinear", 2), ("bilinear", 10), ("cubicspline", 3)])
def test_resampling_to_a_coarser_grid_reads_every_cell(spark, method, ratio):
    src, dst = g.GridSpec(0.0, 0.0, 1.0, 60, 60), g.GridSpec(0.0, 0.0, float(ratio), 60 // ratio, 60 // ratio)
    df = src.cells(spark).select("ix", "iy", F.when(F.col("ix") % ratio == 0, 10.0 * ratio).otherwise(0.0).alias("v"))
    out = g.regrid(df, src, dst, ["v"], method)
    assert out.count() == dst.nx * dst.ny
    inner = out.where(f"ix BETWEEN 2 AND {dst.nx - 3} AND iy BETWEEN 2 AND {dst.ny - 3}")
    assert inner.where("abs(v - 10) > 1.01").count() == 0


def test_regrid_fills_gaps_by_layer(spark):
    src = g.GridSpec(0.0, 0.0, 1.0, 4, 4)
    cells = src.cells(spark).select("ix", "iy")
    df = cells.withColumn("layer", F.lit("a")).withColumn("v", F.lit(2.0)).where("ix <> 1 OR iy <> 1")
    df = df.unionByName(cells.withColumn("layer", F.lit("b")).withColumn("v", F.when(F.col("ix") > 0, 3.0)))
    near = {(r.layer, r.ix, r.iy): r.v for r in g.regrid(df, src, src, ["v"], "bilinear", ["layer"], fill_na=True).collect()}
    assert near == {(k, x, y): {"a": 2.0, "b": 3.0}[k] for k in "ab" for x in range(4) for y in range(4)}


def test_small_unit_series_keep_scaled_anomalies(spark):
    rows = [(0, 0, D(2000 + y, 1, 1), 2e-9 + y * 1e-10) for y in range(5)] + [(1, 0, D(2000 + y, 1, 1), 0.1) for y in range(5)]
    df = series(spark, rows)
    name = [c for c in df.columns if c not in ("ix", "iy", "date")][0]
    out = climatology.own_anomalies(df, [name]).collect()
    assert all((r[f"anomaly_scaled_{name}"] is None) == (r.ix == 1) for r in out)


@pytest.mark.parametrize("method", ["bilinear", "cubicspline"])
def test_resampling_keeps_a_constant_and_covers_the_target(spark, method):
    src, dst = g.GridSpec(0.0, 0.0, 1.0, 6, 6), g.GridSpec(0.0, 0.0, 0.25, 24, 24)
    df = src.cells(spark).select("ix", "iy", F.when(F.col("ix") != 3, 2.5).alias("v"))
    out = g.resample(df, src, dst, ["v"], method)
    assert out.count() == 24 * 24
    assert out.where("v IS NOT NULL AND abs(v - 2.5) > 1e-9").count() == 0


def test_bilinear_is_exact_on_a_plane(spark):
    src, dst = g.GridSpec(0.0, 0.0, 1.0, 6, 6), g.GridSpec(1.0, 1.0, 0.5, 8, 8)
    df = src.cells(spark).select("ix", "iy", (2 * F.col("x") - 3 * F.col("y")).alias("v"))
    out = dst.with_centres(g.resample(df, src, dst, ["v"], "bilinear"))
    assert out.where("abs(v - (2 * x - 3 * y)) > 1e-9").count() == 0


def test_dominant_band_ties_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0, 3.0), (None, None, 1.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(g.dominant_band(["a", "b", "c"])).collect()] == [2, 3, None]


def test_landcover_gap_rule(spark):
    rows = [(0, 0, 0.2, 0.3, 0.5), (0, 1, 0.2, None, None), (0, 2, None, 0.3, 0.5)]
    df = spark.createDataFrame(rows, "ix int, iy int, trees double, water double, bare double")
    got = {(r.ix, r.iy): (r.trees, r.water, r.bare) for r in layers.fill_landcover(df, ["trees", "water", "bare"]).collect()}
    assert got == {(0, 0): (0.2, 0.3, 0.5), (0, 1): (0.2, 0.0, 0.8)}


def test_box_tiles_widen_a_thin_last_strip(spark):
    df = spark.createDataFrame([("a", 0.0, 9.0, 0.0, 8.0)], "id string, xmin double, xmax double, ymin double, ymax double")
    got = {(r.x_lo, r.x_hi, r.y_lo, r.y_hi) for r in g.box_tiles(df).collect()}
    assert got == {(x0, x1, y0, y1) for x0, x1 in ((0, 4), (4, 8), (8, 10.01)) for y0, y1 in ((0, 4), (4, 8))}


# --- ranks ----------------------------------------------------------------------------------------------------


def test_row_numbers_and_running_totals(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(40), rnd.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int, n int")
    got = {r.id: r.rn for r in ranks.row_numbers(df, ["v", "id"], "rn", ranges=7).collect()}
    want = {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v, _ in rows))}
    assert got == want
    grouped = df.groupBy((F.col("id") % 3).alias("g"), "v").agg(F.sum("n").alias("n"))
    out = ranks.running_totals(grouped, [F.col("v").desc()], {"total": "n"}, ["g"], ranges=5).collect()
    for r in out:
        assert r.total == sum(n for i, v, n in rows if i % 3 == r.g and v >= r.v)


def test_key_coverage(spark):
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    out = joins.key_coverage({"a": key(1, 2, 3, 3), "b": key(2, 3, 4), "c": key(3, 9)}, ["k"])
    assert {r.source: r.surviving for r in out.collect()} == {"a": 3, "b": 2, "c": 1}


# --- assembly and sinks ---------------------------------------------------------------------------------------


def test_assembly_drops_null_and_copies_but_keeps_nan(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (0, 1, None), (1, 1, float("nan"))], "ix int, iy int, a double")
    b = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 1, "z")], "ix int, iy int, b string")
    out = assemble.assemble_predictors({"a": a, "b": b})
    assert sorted((r.ix, r.iy, r.b) for r in out.collect()) == [(0, 0, "x"), (1, 1, "z")]


def test_join_layers_refuses_null_outside_scaled(spark):
    dyn = spark.createDataFrame([(0, 0, D(2020, 1, 1), 1.0)], "ix int, iy int, date date, v double")
    ok = spark.createDataFrame([(0, 0, None)], "ix int, iy int, v_scaled double")
    bad = spark.createDataFrame([(0, 0, None)], "ix int, iy int, other double")
    assert assemble.join_layers([ok], [dyn]).count() == 1
    with pytest.raises(Exception, match="NULL in other"):
        assemble.join_layers([bad], [dyn]).collect()


def test_materialize_only_missing_and_refreshed(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda build: spark.createDataFrame([(k, build) for k in (1, 2, 3)], "k int, build int")
    writers.materialize(frame(1).where("k < 3"), path, ["k"])
    out = writers.materialize(frame(2), path, ["k"], refresh=F.col("k") == 2)
    assert {(r.k, r.build) for r in out.collect()} == {(1, 1), (2, 2), (3, 2)}
    out = writers.materialize(frame(3), path, ["k"], overwrite=True)
    assert {r.build for r in out.collect()} == {3}
    assert writers.missing_keys(frame(4), path, ["k"]).count() == 0


def test_spec_csv_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "spec.csv"
    f.write_bytes("﻿var,aggregating_function,units,notes,source\nx,,deg,,\ncases,SUM,count,,\nt,avg,C,,\n".encode())
    assert readers.spec_to_dict(readers.read_aggregation_spec(spark, str(f))) == {"x": None, "cases": "SUM", "t": "AVG"}


def test_coverage_checks(spark):
    df = date_frame(spark, [D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 5), D(2020, 1, 5)])
    assert sorted(r.date.day for r in validation.missing_dates(df).collect()) == [3, 4]
    assert [r.date.day for r in validation.duplicate_keys(df, ["date"]).collect()] == [5]
    assert validation.is_even(df, "date").collect()[0].even is False


def test_recode_and_clamp(spark):
    df = spark.createDataFrame([(5,), (6,), (None,)], "t int")
    got = [r[0] for r in df.select(columns.recode(F.col("t"), layers.TEXTURE_GROUPS, "0", "UNK")).collect()]
    assert got == ["1", "0", "UNK"]
    assert [r[0] for r in df.select(columns.clamp(F.col("t").cast("double"), 0.0, 5.5)).collect()] == [5.0, 5.5, None]


# --- folds and metrics ----------------------------------------------------------------------------------------


def test_model_dates_are_stable_when_years_are_added(spark):
    few = {r.date for r in calendars.model_dates(spark, 2010, 2011, 2, seed=212).collect()}
    more = {r.date for r in calendars.model_dates(spark, 2010, 2012, 2, seed=212).collect()}
    assert len(few) == 48 and few == {d for d in more if d.year < 2012}
    cut = calendars.model_dates(spark, 2010, 2010, today=D(2010, 1, 31))
    assert cut.count() == 31
    with pytest.raises(ValueError):
        calendars.model_dates(spark, 2011, 2010)


def test_outer_folds_definition(spark):
    data = date_frame(spark, days(D(2005, 1, 1), 600))
    got = {(r.date, r.fold_id, r.role) for r in folds.outer_assignments(data, "2005-04-07", "2006-02-01", 100, 45).collect()}
    want = set()
    ends = [d for d in days(D(2005, 4, 7), 100, 45) if d <= D(2006, 2, 1)]
    for i, end in enumerate(ends, 1):
        for d in days(D(2005, 1, 1), 600):
            if d <= end:
                want.add((d, i, "train"))
            elif d <= end + dt.timedelta(days=100):
                want.add((d, i, "assess"))
    assert got == want


@pytest.mark.parametrize("n,k", [(23, 5), (12, 4), (7, 3)])
def test_balanced_clusters_follow_the_two_passes(spark, n, k):
    rnd = random.Random(n)
    pts = {f"r{i:02d}": (rnd.random(), rnd.random()) for i in range(n)}
    centres = [(rnd.random(), rnd.random()) for _ in range(k)]
    df = spark.createDataFrame([(r, *p) for r, p in pts.items()], "region string, x double, y double")
    got = {r.region: r.cluster for r in folds.balanced_clusters(df, centres).collect()}
    d2 = lambda r, c: (pts[r][0] - centres[c][0]) ** 2 + (pts[r][1] - centres[c][1]) ** 2
    free, want = sorted(pts), {}
    for c in range(k):
        for r in sorted(free, key=lambda r: (d2(r, c), r))[: n // k]:
            want[r] = c + 1
        free = [r for r in free if r not in want]
    room = {c: 1 for c in range(k)}
    for r in free:
        c = min((c for c in room if room[c]), key=lambda c: d2(r, c))
        want[r], room[c] = c + 1, 0
    assert got == want
    sizes = [list(got.values()).count(c + 1) for c in range(k)]
    assert set(sizes) <= {n // k, -(-n // k)}


def test_inner_folds_are_disjoint_and_complete(spark):
    clusters = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "region string, cluster int")
    got = {(r.region, r.inner_fold): r.inner_role for r in folds.inner_assignments(clusters).collect()}
    assert got == {("a", 1): "assess", ("a", 2): "train", ("b", 1): "train", ("b", 2): "assess", ("c", 1): "train", ("c", 2): "assess"}


def test_metrics_with_ties_match_pairwise_definition(spark):
    rnd = random.Random(9)
    rows = [(i % 3, rnd.randrange(2), rnd.randrange(6) / 5) for i in range(200)]
    df = spark.createDataFrame(rows, "fold int, outbreak int, pred_1 double")
    for r in modelling.classification_metrics(df, ["fold"]).collect():
        pos = [s for f, y, s in rows if f == r.fold and y]
        neg = [s for f, y, s in rows if f == r.fold and not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        assert r.roc_auc == pytest.approx(auc)
        assert r.recall == pytest.approx(sum(p >= 0.5 for p in pos) / len(pos))
    one = modelling.classification_metrics(df.drop("fold")).collect()
    assert len(one) == 1 and 0 < one[0].pr_auc < 1


def test_select_best_is_repeatable_on_ties(spark):
    rows = [(s, "roc_auc", e) for s, es in ((1, (0.6, 0.8)), (2, (0.7, 0.7)), (3, (0.5, 0.6))) for e in es]
    df = spark.createDataFrame(rows, "setting int, metric string, estimate double")
    first = modelling.select_best(df, ["setting"], seed=3).collect()
    assert len(first) == 1 and first[0].setting in (1, 2) and first[0].n == 2
    assert modelling.select_best(df.orderBy(F.desc("setting")), ["setting"], seed=3).collect() == first


def test_parameter_grid_fills_the_space():
    grid = modelling.parameter_grid(100, 8, seed=4)
    assert len(grid) == 100 and {p["mtry"] for p in grid} == set(range(1, 9))
    assert grid == modelling.parameter_grid(100, 8, seed=4)


# --- skew and plans -------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_with_many_copies(spark):
    """One cell and day holds most rows; lags, climatology and ids stay exact."""
    hot = [(0, 0, D(2020, 1, 5), 1.0)] * 3000
    rest = [(0, 0, D(2020, 1, 20), 3.0), (0, 0, D(2020, 1, 5), 5.0), (1, 0, D(2020, 1, 20), 7.0)]
    df = series(spark, hot + rest)
    lags = windows.interval_lags(df, ["v"], 30, 1)
    assert lags.count() == 3003
    got = lags.where("ix = 0 AND date = DATE'2020-01-20'").collect()[0].v_lag_30
    assert got == pytest.approx((3000 + 5) / 3001)
    ids = ranks.row_numbers(df.withColumn("u", F.monotonically_increasing_id()), ["date", "v", "u"], "rn", ranges=6)
    assert ids.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).collect()[0][:] == (3003, 1, 3003)


def test_assembly_collapses_copies_before_joining(spark):
    a = spark.createDataFrame([(0, 0, 1)] * 500 + [(0, 1, 2)], "ix int, iy int, a int")
    b = spark.createDataFrame([(0, 0, "x")] * 500 + [(0, 1, "y")], "ix int, iy int, b string")
    assert assemble.assemble_predictors({"a": a, "b": b}).count() == 2


def test_forecast_anomalies_shuffle_nothing_after_placing(spark, tmp_path):
    base = D(2020, 3, 1)
    fc = spark.createDataFrame([(0, 0, base, 3, 2020, 1.0)], "ix int, iy int, base_date date, lead_month int, lead_year int, v double")
    clim = spark.createDataFrame([(0, 0, 80, 1.0, 2.0)], "ix int, iy int, doy int, v double, v_sd double")
    for name, df in (("fc", fc), ("clim", clim)):
        df.write.parquet(str(tmp_path / name))
    fc, clim = spark.read.parquet(str(tmp_path / "fc")), spark.read.parquet(str(tmp_path / "clim"))
    plan = plan_of(forecast.forecast_anomalies(fc, clim, date_frame(spark, [D(2020, 3, 20)]), (0, 30), ["v"]))
    by_cell = [line for line in plan.splitlines() if "Exchange hashpartitioning(ix" in line]
    assert len(by_cell) == 1 and "Join" not in plan and "Window" not in plan  # forecast and climatology meet once


def test_forecast_anomalies_of_daily_dates_do_not_repeat_the_climatology(spark):
    clim = spark.createDataFrame([(x, 0, d, float(d), 1.0) for x in range(3) for d in range(1, 367) if d % 5], "ix int, iy int, doy int, v double, v_sd double")
    dates = date_frame(spark, days(D(2020, 1, 1), 366))
    segments = forecast.interval_segments(dates, (0, 30, 60))
    got = {(r.ix, r.first_doy, r.last_doy): (r._days, r._s_v) for r in forecast._segment_sums(clim, segments, ["v"], ["ix", "iy"]).collect()}
    spans = {(r.first_doy, r.last_doy) for r in segments.collect()}
    want = {(x, a, b): [d for d in range(a, b + 1) if d % 5] for x in range(3) for a, b in spans}
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items() if v}
    assert all(abs(got[k][1] - sum(v)) < 1e-6 for k, v in want.items() if v)
    plan = plan_of(forecast._segment_sums(clim, segments, ["v"], ["ix", "iy"]))
    assert "Join" not in plan


def test_forecast_and_recorded_in_one_pass_equal_the_join(spark):
    rng = random.Random(4)
    cells = [(x, y) for x in range(3) for y in range(2)]
    value = lambda: rng.choice([rng.uniform(-5, 5)] * 8 + [None, math.nan, 1e17])
    daily = spark.createDataFrame([(x, y, d, value()) for x, y in cells for d in days(D(2019, 11, 1), 400) if rng.random() < 0.97] * 1, "ix int, iy int, date date, v double")
    clim = spark.createDataFrame([(x, y, d, value(), rng.choice([None, 0.0, 1.0, 2.0])) for x, y in cells[:5] for d in range(1, 367) if rng.random() < 0.9], "ix int, iy int, doy int, v double, v_sd double")
    months = [(D(2019 + m // 12, m % 12 + 1, 1), (m + n) % 12 + 1, 2019 + (m + n) // 12) for m in range(10, 22) for n in range(6)]
    fc = spark.createDataFrame([(x, y, b, m, yr, value()) for x, y in cells[1:] for b, m, yr in months], "ix int, iy int, base_date date, lead_month int, lead_year int, v double")
    dates = date_frame(spark, days(D(2020, 1, 3), 9, 31))
    args = (clim, dates, (0, 30, 60, 150), ["v"])
    joined = forecast.validate_forecast(forecast.forecast_anomalies(fc, *args), daily, *args, wide=False)
    once = forecast.forecast_and_recorded(fc, daily, *args)
    assert once.columns == joined.columns
    show = lambda df: sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in r) for r in df.collect())
    assert show(once) == show(joined) and once.count() == 5 * 9 * 3


def test_strides_sum_exactly_the_days_of_a_range():
    from fieldgrid.plans.cells import stride_sums

    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (101, 4)).astype(float)
    start = np.repeat(np.arange(101), 5)
    length = np.minimum(np.tile([0, 1, 7, 31, 101], 101), 101 - start)
    assert (stride_sums(x, start, length) == [x[a : a + n].sum(0) for a, n in zip(start, length)]).all()


def test_odd_days_touch_only_the_ranges_that_cover_them(spark):
    value = {d: 0.1 * (d + 60) for d in range(-50, 51)} | {-40: math.nan, -20: math.inf, 0: 1e17, 7: None}
    rows = spark.createDataFrame([(0, d, v) for d, v in value.items()], "ix int, d int, v double")
    spans = [(a, a + n) for a in range(-50, 51) for n in (0, 4, 29, 70)]
    ranges = spark.createDataFrame(spans, "a int, b int")
    out = forecast.range_sums(rows, "d", {"s": F.col("v"), "n": F.col("v").isNotNull().cast("long")}, ranges, "a", "b", ["ix"])
    got = {(r.a, r.b): (r.s, r.n) for r in out.collect()}
    assert len(got) == len(set(spans))
    for (a, b), (s, n) in got.items():
        inside = [value[d] for d in range(a, b + 1) if value.get(d) is not None]
        assert n == len(inside) and s == pytest.approx(math.fsum(inside), rel=1e-12, abs=1e-12, nan_ok=True)


def test_masking_does_not_shuffle_rows(spark):
    plan = plan_of(regions.mask_to_regions(series(spark, [(0, 0, D(2020, 1, 1), 1.0)]), shape_frame(spark), GRID))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_large_lookup_is_not_broadcast(spark):
    from fieldgrid.session import broadcast_if_small

    lookup = spark.range(50).withColumnRenamed("id", "k")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(lookup, 50)) and not hinted(broadcast_if_small(lookup, 49))


def test_vegetation_fusion_shuffles_composites_not_days(spark):
    rows = spark.createDataFrame([(0, 0, D(2020, 1, 1), D(2020, 1, 16), 1.0)], "ix int, iy int, start_date date, end_date date, ndvi double")
    fused = climatology.fuse_sources({s: climatology.expand_composites(rows) for s in ("modis", "sentinel")})
    exchanges = [line for line in plan_of(fused).splitlines() if "Exchange hashpartitioning" in line]
    assert fused.count() == 16 and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_bioclim_names(spark):
    bands = spark.createDataFrame([(0, 0, *[float(i) for i in range(19)])], ["ix", "iy", *[f"bio_{i}" for i in range(1, 20)]])
    out = layers.bioclim_layer(bands).collect()[0]
    assert out["Annual_Mean_Temperature"] == 0.0 and out["Precipitation_of_Coldest_Quarter"] == 18.0
    with pytest.raises(ValueError):
        layers.bioclim_layer(bands.drop("bio_19"))


def test_region_aggregate_leaves_out_the_common_outline(spark):
    spec = g.GridSpec(-0.5, -0.5, 1.0, 8, 8)  # cell centres on whole degrees
    df = spec.cells(spark).select("ix", "iy", F.lit(1.0).alias("v"), F.lit(D(2020, 1, 1)).alias("date"))
    out = {r.region: r.v_sum for r in regions.aggregate_by_region(df, shape_frame(spark), spec, {"date": None, "v": "SUM"}).collect()}
    # The common box is 0..6 x 0..4.  Strictly inside it, "ell" touches (1..4, 1), (1, 2) and (1, 3).
    ell = [(x, y) for x in range(1, 6) for y in range(1, 4) if (x <= 4 and y <= 1) or (x <= 1 and y <= 4)]
    assert len(ell) == 6 and out["ell"] == float(len(ell))
    masked = regions.mask_to_regions(df, shape_frame(spark), spec).where("region = 'ell'").count()
    assert masked == 5 * 2 + 2 * 3  # the mask keeps the outline


def test_nearest_fill_per_key(spark):
    rows = [(d, x, 0, v) for d, vs in ((1, "a--b"), (2, "-c--"), (3, "----")) for x, v in enumerate(vs)]
    df = spark.createDataFrame([(d, x, y, None if v == "-" else v) for d, x, y, v in rows], "d int, ix int, iy int, v string")
    got = {(r.d, r.ix): r.v for r in nearest.fill_nearest(df, ["v"], ["d"]).collect()}
    assert [got[(1, x)] for x in range(4)] == ["a", "a", "b", "b"]
    assert [got[(2, x)] for x in range(4)] == ["c"] * 4 and [got[(3, x)] for x in range(4)] == [None] * 4


def test_lags_on_unique_days_agree_with_the_general_form(spark):
    rnd = random.Random(11)
    df = series(spark, [(c, 0, d, rnd.choice([None, rnd.random()])) for c in (0, 1) for d in days(D(2020, 1, 1), 70) if rnd.random() < 0.8])
    for name in ("avg", "sum", "min", "max", "count"):
        a = windows.interval_lags(df, ["v"], 10, 2, agg=name)
        b = windows.interval_lags(df, ["v"], 10, 2, agg=name, one_row_per_day=True)
        key = lambda r: (r.ix, r.date)
        for x, y in zip(sorted(a.collect(), key=key), sorted(b.collect(), key=key)):
            assert (x.v_lag_10, x.v_lag_20) == pytest.approx((y.v_lag_10, y.v_lag_20), nan_ok=True) or (x.v_lag_10, x.v_lag_20) == (y.v_lag_10, y.v_lag_20)


@pytest.mark.parametrize("cumulative", [True, False])
def test_rolling_origin_definition(spark, cumulative):
    dates = days(D(2020, 1, 1), 31)
    got = {(r.date, r.fold_id, r.role) for r in folds.rolling_origin(date_frame(spark, dates), 10, 3, 4, cumulative=cumulative).collect()}
    want = set()
    for i, stop in enumerate(range(10, 31 - 3 + 1, 5), 1):
        for r, d in enumerate(dates, 1):
            if r <= stop and (cumulative or r > stop - 10):
                want.add((d, i, "train"))
            elif stop < r <= stop + 3:
                want.add((d, i, "assess"))
    assert got == want
    bounds = [(r.fold_id, r.train_to, r.assess_from, r.assess_to) for r in folds.rolling_origin_bounds(spark, 31, 10, 3, 4).orderBy("fold_id").collect()]
    assert bounds == [(i, s, s + 1, s + 3) for i, s in enumerate(range(10, 29, 5), 1)]


def test_damaged_and_half_written_periods_are_built_again(spark, tmp_path):
    path = str(tmp_path / "stored")
    df = spark.createDataFrame([(i, 2000 + i % 3) for i in range(30)], "v int, year int")
    build = lambda k: df.withColumn("build", F.lit(k))
    writers.materialize(build(1), path, ["year"])
    damaged = next((tmp_path / "stored" / "year=2001").glob("*.parquet"))
    damaged.write_bytes(b"PAR1 cut off")
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    half = tmp_path / "stored" / "year=2002" / "part-half.parquet"
    half.write_bytes(b"PAR1 begun")
    got = writers.materialize(build(2), path, ["year"]).groupBy("year", "build").count().collect()
    assert {(r.year, r.build, r["count"]) for r in got} == {(2000, 1, 10), (2001, 2, 10), (2002, 2, 10)}


def test_other_read_errors_are_raised(spark, tmp_path):
    (tmp_path / "year=1").mkdir()
    (tmp_path / "year=1" / "x.parquet").write_bytes(b"")
    (tmp_path / "other=2").mkdir()
    (tmp_path / "other=2" / "y.parquet").write_bytes(b"")
    with pytest.raises(Exception, match="(?i)partition"):
        writers.existing_keys(spark, str(tmp_path), spark.createDataFrame([], "year int").schema)


def test_distinct_natural_join_moves_each_stored_source_once(spark, tmp_path):
    for name, column in (("a", "u"), ("b", "v")):
        rows = [(i % 4, i % 3, float(i % 6)) for i in range(60)] + [(None, 1, 1.0)]
        spark.createDataFrame(rows, f"ix int, iy int, {column} double").write.parquet(str(tmp_path / name))
    frames = [spark.read.parquet(str(tmp_path / n)) for n in "ab"]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.natural_join_distinct(frames)
        assert plan_of(out).count("Exchange hashpartitioning") == 2
        assert out.count() == 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_left_out_location_trains_nothing_else(spark):
    data = spark.createDataFrame([(r, D(2020, 1, d)) for r in "cab" for d in (1, 2)], "region string, date date")
    outer = spark.createDataFrame([(1, D(2020, 1, 1), "train"), (1, D(2020, 1, 2), "assess")], "fold_id int, date date, role string")
    inner = folds.leave_location_out(data, "region")
    assert {(r.region, r.inner_fold) for r in inner.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    rows = folds.fold_rows(data, outer, 1, inner, 2, unlisted="train").collect()
    assert {(r.region, r.inner_role) for r in rows} == {("a", "train"), ("b", "assess"), ("c", "train")} and len(rows) == 3
