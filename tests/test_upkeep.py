"""Sweeps over intervals, mergeable climatology, curve-ordered tables, refresh by content."""

import datetime as dt
import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldgrid.operators import windows
from fieldgrid.operators.grid import GridSpec
from fieldgrid.operators.nearest import cells_within
from fieldgrid.plans import climatology
from fieldgrid.sources import curve
from fieldgrid.sources import refresh as content

D = dt.date


def test_sweep_finds_nested_intervals_in_any_number_of_ranges(spark):
    rng = random.Random(1)
    rows = [("a", D(2020, 1, 1), D(2020, 12, 31)), ("a", D(2020, 2, 1), D(2020, 2, 3)), ("a", D(2020, 3, 1), D(2020, 3, 2)), ("b", D(2020, 1, 1), None)]
    rows += [(rng.choice("abc"), d, d + dt.timedelta(days=rng.randrange(40))) for d in (D(2021, 1, 1) + dt.timedelta(days=rng.randrange(900)) for _ in range(300))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, place string, start_date date, end_date date")
    want = {}
    order = lambda r: (r[1], r[2] or D(1, 1, 1), r[3])
    for place in "abc":
        until = None
        for p, s, e, i in sorted([(p, s, e, i) for i, (p, s, e) in enumerate(rows) if p == place], key=order):
            gap = None if until is None else max(0, (s - until).days - 1)
            shared = None if until is None or e is None else max(0, (min(e, until) - s).days + 1)
            want[i] = (until, gap, shared)
            until = max(filter(None, (until, e)), default=None)
    for n in (1, 7):
        got = {r.id: (r.covered_until, r.gap_days, r.overlap_days) for r in windows.covered_until(df, within=["place"], tie=["id"], ranges=n).collect()}
        assert {i: v for i, v in got.items() if rows[i][2]} == {i: v for i, v in want.items() if rows[i][2]}
    assert got[1][2] == 3 and got[2][2] == 2  # both inside the year, not next to each other


def test_moments_of_years_merge_to_the_climatology(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([1e9 + rng.random()] * 9 + [None])
    rows = [(x, 0, D(2000, 1, 1) + dt.timedelta(days=i), value(), float(i % 5)) for x in range(2) for i in range(0, 2200, 1) if rng.random() < 0.9]
    daily = spark.createDataFrame(rows, "ix int, iy int, date date, v double, w double")
    moments = None
    for year in range(2000, 2007):
        part = climatology.yearly_moments(daily.where(F.year("date") == year), ["v", "w"])
        moments = part if moments is None else moments.unionByName(part)
    merged = {(r.ix, r.doy): r for r in climatology.climatology_from_moments(moments, ["v", "w"]).collect()}
    whole = climatology.climatology(daily, ["v", "w"]).collect()
    assert len(merged) == len(whole)
    for r in whole:
        m = merged[r.ix, r.doy]
        assert (m.v is None) == (r.v is None) and (m.v_sd is None) == (r.v_sd is None) and (m.w_sd is None) == (r.w_sd is None)
        assert m.v is None or abs(m.v - r.v) < 1e-5
        assert m.v_sd is None or abs(m.v_sd - r.v_sd) < 1e-5
        assert math.isclose(m.w, r.w, abs_tol=1e-12)
    assert climatology.climatology_from_moments(moments.limit(0), ["v", "w"]).collect() == []


def test_a_box_reads_few_files_of_a_curve(spark, tmp_path):
    rows = spark.range(40 * 40 * 64).select((F.col("id") % 40).cast("int").alias("ix"), (F.col("id") / 40 % 40).cast("int").alias("iy"), F.expr("date_add(date'2000-01-01', cast(id / 1600 as int))").alias("date"), F.rand(1).alias("v"))
    path = curve.write_along_curve(rows, str(tmp_path / "curve"), 64, origin="2000-01-01")
    files = glob.glob(f"{path}/*.parquet")

    def meets(file):
        group = pq.ParquetFile(file).metadata
        for g in range(group.num_row_groups):
            s = {group.row_group(g).column(c).path_in_schema: group.row_group(g).column(c).statistics for c in range(4)}
            if s["ix"].min <= 11 and s["ix"].max >= 8 and s["iy"].min <= 11 and s["iy"].max >= 8 and s["date"].min <= D(2000, 1, 15) and s["date"].max >= D(2000, 1, 10):
                return True
        return False

    assert len(files) == 64 and sum(map(meets, files)) <= 12
    box = "ix BETWEEN 8 AND 11 AND iy BETWEEN 8 AND 11 AND date BETWEEN DATE '2000-01-10' AND DATE '2000-01-15'"
    got = spark.read.parquet(path).where(box)
    assert got.count() == 4 * 4 * 6 and got.dtypes == rows.dtypes
    assert "PushedFilters" in got._jdf.queryExecution().toString()


def test_curve_key_interleaves_bits(spark):
    (r,) = spark.createDataFrame([(5, 3, 6, None)], "a int, b int, c int, d int").select(curve.curve_key(F.col("a"), F.col("b"), F.col("c"), bits=3).alias("k"), curve.curve_key(F.col("d"), F.col("d")).alias("z")).collect()
    bits = [(n >> b) & 1 for b in range(3) for n in (5, 3, 6)]
    assert r.k == sum(v << i for i, v in enumerate(bits)) and r.z == 0


def yearly(rows):
    return rows.groupBy("year").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


def test_only_changed_periods_are_built(spark, tmp_path):
    path = str(tmp_path / "data")
    base = [(y, float(i)) for y in (2000, 2001, 2002) for i in range(5)]
    run = lambda rows: content.refresh(spark.createDataFrame(rows, "year int, v double").repartition(3), yearly, path, ["year"])
    show = lambda df: {r.year: (r.v, r.n) for r in df.collect()}
    out, built = run(base)
    assert built == 3 and show(out) == {y: (10.0, 5) for y in (2000, 2001, 2002)}
    out, built = run(base[::-1])  # another order is the same content
    assert built == 0 and len(show(out)) == 3
    changed = [(y, v + (y == 2000 and v == 3.0)) for y, v in base] + [(2003, 1.0)]
    out, built = run(changed)
    assert built == 2 and show(out) == {2000: (11.0, 5), 2001: (10.0, 5), 2002: (10.0, 5), 2003: (1.0, 1)}
    out, built = run([r for r in changed if r[0] != 2001] + [(2002, 4.0)])  # one period gone, one with a repeated row
    assert built == 1 and show(out) == {2000: (11.0, 5), 2002: (14.0, 6), 2003: (1.0, 1)}


def test_a_run_that_dies_before_its_manifest_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "data")
    frame = lambda rows: spark.createDataFrame(rows, "year int, v double")
    content.refresh(frame([(2000, 1.0), (2001, 2.0)]), yearly, path, ["year"])

    def dies(rows):
        return yearly(rows).withColumn("v", F.when(F.col("year") == 2001, F.raise_error(F.lit("gone"))).otherwise(F.col("v")).cast("double"))

    changed = frame([(2000, 1.5), (2001, 2.5)])
    with pytest.raises(Exception, match="gone"):
        content.refresh(changed, dies, path, ["year"])
    stored = content.stored(spark, path, yearly(changed), ["year"])
    assert {r.year: r.v for r in stored.collect()} == {2000: 1.0, 2001: 2.0}
    out, built = content.refresh(changed, yearly, path, ["year"])
    assert built == 2 and {r.year: r.v for r in out.collect()} == {2000: 1.5, 2001: 2.5}


def test_reach_goes_across_the_date_line_once(spark):
    grid = GridSpec(-180.0, -10.0, 1.0, 360, 20)
    points = spark.createDataFrame([(1, 179.9, 0.2), (2, -179.9, 0.2), (3, 0.0, 9.9)], "id int, longitude double, latitude double")
    for flat in (False, True):
        found = cells_within(points, grid, 300.0, ellipsoid=flat).collect()
        cells = {i: [(r.ix, r.iy) for r in found if r.id == i] for i in (1, 2, 3)}
        assert all(len(c) == len(set(c)) for c in cells.values())
        assert {ix for ix, _ in cells[1]} == {ix for ix, _ in cells[2]} == {357, 358, 359, 0, 1, 2}
        assert {(359 - ix, iy) for ix, iy in cells[1]} == set(cells[2])
    wide = cells_within(points.where("id = 1"), grid, 25_000.0).count()
    assert wide == 360 * 20
