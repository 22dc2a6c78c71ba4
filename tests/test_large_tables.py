"""What large tables need of a plan, and the same rows as before on odd small ones."""

import datetime as dt

import pytest

D = dt.date


@pytest.fixture
def orders_dir(spark, tmp_path):
    """Orders and shipments of a few cells, some keys repeated or null."""
    day = lambda i: D(1997, 11, 1) + dt.timedelta(days=i)
    orders = [(i, (i * 37) % 600 if i % 19 else None, day(i % 200), 1000.0 * i) for i in range(400)] * 2
    items = [(i % 700, i % 9, 1 + i % 7, float(i % 50), 90.0 * i, i % 10 / 100, day(i % 300)) for i in range(3000)]
    items += [(None, 3, 1, 2.0, 3.0, 0.1, day(5)), (5, 5, 1, None, None, None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    columns = "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date"
    spark.createDataFrame(items, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_map_view_is_one_layer_of_the_wide_table(spark, orders_dir):
    from fieldgrid.checks import catalog

    view = catalog.QUERIES["P16_map_view"](spark, orders_dir)
    wide = catalog.QUERIES["D08_validate_forecast_wide"](spark, orders_dir).where("date = '1998-03-15'")
    name = "anomaly_temperature_difference_59"
    limited = {(r.ix, r.iy): r[name] if r[name] is None else max(-6.4, min(6.4, r[name])) for r in wide.collect()}
    assert view.columns == ["ix", "iy", name] and limited
    assert {(r.ix, r.iy): r[name] for r in view.collect()} == limited


def members(spark, n=40):
    rows = [(i % 3, i % 2, D(2020, 1 + i % 2, 1), k, D(2020, 2 + i % 2 + k, 1), v, u, float(i * k)) for i in range(n) for k in (0, 1) for v, u in (("temperature", "C"), ("dewpoint", "C"), ("precipitation", ""))]
    return spark.createDataFrame(rows, "ix int, iy int, base_date date, lead_months int, forecast_end_date date, variable string, units string, value double")


@pytest.mark.parametrize("name", ["ensemble_stats", "normalize_forecast"])
def test_members_are_placed_once_and_without_a_state_each(spark, name):
    from fieldgrid.plans import forecast

    stats = getattr(forecast, name)(members(spark))
    if name == "ensemble_stats":
        stats = stats.groupBy("ix", "iy", "base_date", "lead_months").pivot("variable", ["temperature", "dewpoint"]).agg({"mean": "first"})
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange") > plan.rindex("HashAggregate")


def test_wide_validation_shows_what_its_long_form_has(spark):
    """Repeated forecasts, intervals without a forecast or a record, odd numbers and null keys."""
    import math

    from pyspark.sql import functions as F

    from fieldgrid.plans import forecast

    values = [1.0, -2.5, None, math.nan, 7.25]
    start = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    daily = spark.createDataFrame([(0, y, d, float(d.day + y)) for y in (0, 1) for d in start[:45]], "ix int, iy int, date date, v double")
    clim = spark.createDataFrame([(0, y, d, 3.0 + d % 4, 1.5) for y in (0, 1) for d in range(1, 120)], "ix int, iy int, doy int, v double, v_sd double")
    dates = spark.createDataFrame([(D(2020, 1, 5),), (D(2020, 1, 20),)], "date date")
    keys = [(0, 0, D(2020, 1, 5), 30), (0, 0, D(2020, 1, 5), 30), (0, 1, D(2020, 1, 5), 60), (0, 1, D(2020, 1, 20), 30), (5, 5, D(2020, 1, 20), 60), (None, 0, D(2020, 1, 5), 30)]
    rows = [(*k, values[i % 5], values[(i + 1) % 5]) for i, k in enumerate(keys)]
    anom = spark.createDataFrame(rows, "ix int, iy int, date date, forecast_interval int, anomaly_forecast_v double, anomaly_forecast_scaled_v double")
    args = (anom, daily, clim, dates, (0, 30, 60), ["v"])
    long = forecast.validate_forecast(*args, wide=False)
    names = [c for c in long.columns if c.startswith("anomaly")]
    pick = [F.max(F.when(F.col("forecast_interval") == e, F.col(c))).alias(f"{c}_{e - 1}") for e in (30, 60) for c in names]
    want, got = long.groupBy("ix", "iy", "date").agg(*pick), forecast.validate_forecast(*args)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "forecast_interval#" not in plan[: plan.index("Join")]  # the sides meet as one row a cell and date


def test_partial_is_called_once_a_group_for_many_batches(spark):
    from pyspark.sql import functions as F

    from fieldgrid.checks.q_groups import slope
    from fieldgrid.operators import groups

    whole, calls = slope(), spark.sparkContext.accumulator(0)

    def counted(rows):
        calls.add(1)
        return whole.partial(rows)

    few = groups.Mergeable(whole.state, whole.out, counted, whole.merge, whole.finish)
    df = spark.range(40_000, numPartitions=1).select((F.col("id") % 100).alias("k"), F.col("id").cast("int").alias("day"), F.col("id").cast("double").alias("v"))
    assert {(r.n, round(r.slope, 9)) for r in groups.aggregate_groups(df, ["k"], few).collect()} == {(400, 1.0)}
    assert calls.value == 100


def test_weather_is_placed_by_cell_on_all_partitions(spark, orders_dir):
    from fieldgrid.checks import adapters

    plan = adapters.daily(spark, orders_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and plan.index("Exchange") > plan.rindex("HashAggregate")


def test_key_coverage_groups_keys_once(spark):
    from fieldgrid.operators import joins

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    out = joins.key_coverage({"a": keys(1, 2, 2, None, 3), "b": keys(2, 3, 3, None), "c": keys(3)}, ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("HashAggregate(keys=[k#") == 2
    assert sorted((r.step, r.surviving) for r in out.collect()) == [(1, 4), (2, 3), (3, 1)]


def test_blocks_of_listings_are_cut_from_arrays(spark):
    from fieldgrid.sources import readers

    one = "Band 1\nX = 0\nDescription = a  b \r\n  Metadata:\n A = 1=2\nA = 9\nB =\nDescription = c\n B =  x  y"
    rows = [("f", one), ("g", one), ("g", one), (None, "Description=z\nA=7"), ("h", None), ("i", "A = 1")]
    df = spark.createDataFrame(rows, "file string, text string").repartition(3)
    out = readers.parse_key_value_blocks(df, "text", ["A", "B"], ["file"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted(map(tuple, out.collect()), key=repr)
    want = [("f", 1, "1=2", ""), ("f", 2, None, "x y"), ("g", 1, None, None), ("g", 2, "1=2", ""), ("g", 3, None, None), ("g", 4, None, "x y"), (None, 1, "7", None)]
    assert got == sorted(want, key=repr)


def test_history_merges_days_that_no_date_tells_apart(spark):
    from fieldgrid.plans import events

    dates = [D(2020, 1, 15), D(2020, 2, 15), D(2020, 2, 20)]
    frame = spark.createDataFrame([(x,) for x in dates] + [(dates[0],)], "date date")
    ages = (1, 10, 40)
    number = lambda x: (x - D(1970, 1, 1)).days
    got = {r._event_day: r._day for r in events._told_apart(frame, ages).collect()}
    assert set(got) == set(range(number(dates[0]) - 40, number(dates[-1])))
    reached = lambda e: [e + a <= number(x) for x in dates for a in ages]
    assert all(e <= m and reached(e) == reached(m) for e, m in got.items()) and len(set(got.values())) <= 9
    assert events._told_apart(frame.where("false"), ages).count() == 0


def test_district_days_are_stored_once(spark, orders_dir, monkeypatch):
    from fieldgrid.checks import q_boosting

    frame = spark.createDataFrame([("r", D(1999, 1, 1), 2.0, 1)], "region string, date date, quantity double, outbreak int")
    monkeypatch.setattr(q_boosting.a, "region_rows", lambda spark, d: frame)
    plan = q_boosting.rows(spark, orders_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "LocalTableScan" not in plan and "Project" not in plan
