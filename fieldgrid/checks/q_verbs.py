"""Checks of column verbs, joins, aggregates, windows, sampling, set and reshape operators, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import climate, columns, dates, geo
from ..operators import joins, ranks, windows
from ..operators.grid import GridSpec, crop
from ..operators.nearest import cells_within
from ..plans import assemble, climatology, events, forecast
from ..session import calendar_side
from ..sources import readers
from . import adapters as a
from . import q_features as qf
from .registry import cte, query

W = " ".join(a.WEATHER)


# --- projection, filter, column verbs -------------------------------------------------------------------------


@query("P01_relocate", "SELECT temperature, date, ix, iy, precipitation, relative_humidity FROM daily", W)
def _(spark, d):
    return columns.relocate(a.daily(spark, d), ["temperature", "date"])


@query("P02_select_by_pattern", "SELECT ix, iy, anomaly_temperature, anomaly_scaled_temperature FROM anoms", "anomaly_temperature anomaly_scaled_temperature")
def _(spark, d):
    df = climatology.own_anomalies(a.daily(spark, d), a.WEATHER)
    keep = columns.columns_matching(df, prefix="anomaly", suffix="temperature", without="humidity")
    return df.select("ix", "iy", *keep)


@query("P03_rename", 'SELECT ix AS ix_a, iy AS iy_a, unit, "wc2.1_30s_elev" AS elev FROM layers', "elev")
def _(spark, d):
    df = a.layers(spark, d).select("ix", "iy", F.col("unit").alias("UNIT"), columns.quoted("wc2.1_30s_elev").alias("ELEV"))
    return columns.add_suffix(columns.lower_names(df), ["ix", "iy"], "_a")


@query("P04_computed_columns", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem", "net gross")
def _(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return a.table(spark, d, "lineitem").select("l_orderkey", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"))


@query("P05_mutate_across", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size, round(p_retailprice) AS p_retailprice FROM part", "p_retailprice")
def _(spark, d):
    df = columns.cast_columns(a.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey", "p_size"], "string")
    return columns.mutate_across(df, ["p_retailprice"], lambda c: F.round(c))


@query("P06_equality_and_in", "SELECT ix, iy, date FROM daily WHERE year(date) = 1998 AND month(date) IN (3, 4) OR dayofyear(date) IN (1, 366)")
def _(spark, d):
    rule = (F.year("date") == 1998) & F.month("date").isin(3, 4) | F.dayofyear("date").isin(1, 366)
    return a.daily(spark, d).where(rule).select("ix", "iy", "date")


@query("P07_half_open_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-02-01'")
def _(spark, d):
    day = F.col("o_orderdate")
    return a.table(spark, d, "orders").where((day >= F.lit("1997-01-01").cast("date")) & (day < F.lit("1997-02-01").cast("date"))).select("o_orderkey")


@query(
    "P08_bounding_box",
    "SELECT outbreak_id, TRUE AS strict FROM outbreaks WHERE longitude > 21 AND longitude < 23 AND latitude > -95e-1 AND latitude < -8 "
    "UNION ALL SELECT outbreak_id, FALSE FROM outbreaks WHERE longitude BETWEEN 21 AND 23 AND latitude BETWEEN -95e-1 AND -8",
)
def _(spark, d):
    ob = a.outbreaks(spark, d)
    box = dict(xmin=21.0, xmax=23.0, ymin=-9.5, ymax=-8.0, x="longitude", y="latitude")
    inner = crop(ob, **box).select("outbreak_id", F.lit(True).alias("strict"))
    return inner.unionByName(crop(ob, **box, strict=False).select("outbreak_id", F.lit(False).alias("strict")))


@query("P09_drop_missing", "SELECT ix, iy, date, relative_humidity FROM daily WHERE relative_humidity IS NOT NULL", "relative_humidity")
def _(spark, d):
    return columns.drop_incomplete(a.daily(spark, d).select("ix", "iy", "date", "relative_humidity"), ["relative_humidity"])


@query("P10_every_column_present", "SELECT * FROM layers WHERE COLUMNS(*) IS NOT NULL", "wc2.1_30s_elev price")
def _(spark, d):
    return columns.drop_incomplete(a.layers(spark, d))


@query("P11_split_complete", "SELECT ix, iy, economy IS NOT NULL AND small IS NOT NULL AS complete FROM layers")
def _(spark, d):
    full, rest = columns.split_complete(a.layers(spark, d).select("ix", "iy", "economy", "small"))
    return full.select("ix", "iy", F.lit(True).alias("complete")).unionByName(rest.select("ix", "iy", F.lit(False).alias("complete")))


@query("P12_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, d):
    return a.table(spark, d, "part").select("p_brand", "p_type").distinct()


@query(
    "P13_distinct_keep_first",
    "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "o_totalprice",
)
def _(spark, d):
    df = a.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return windows.keep_first(df, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("P14_category_equality", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery'")
def _(spark, d):
    return a.table(spark, d, "customer").where(F.lower("c_mktsegment") == "machinery").select("c_custkey")


@query("P15_clamp", "SELECT ix, iy, date, CASE WHEN relative_humidity IS NOT NULL THEN least(greatest(relative_humidity, 2), 8) END AS relative_humidity FROM daily", "relative_humidity")
def _(spark, d):
    return a.daily(spark, d).select("ix", "iy", "date", columns.clamp(F.col("relative_humidity"), 2.0, 8.0).alias("relative_humidity"))


@query(
    "P16_map_view",
    "SELECT ix, iy, CASE WHEN v IS NOT NULL THEN least(greatest(v, -64e-1), 64e-1) END AS anomaly_temperature_difference_59 FROM (SELECT ix, iy, max(CASE WHEN forecast_interval = 60 THEN anomaly_temperature_difference END) AS v FROM validated WHERE date = DATE '1998-03-15' GROUP BY 1, 2)",
    "anomaly_temperature_difference_59",
)
def _(spark, d):
    return forecast.map_view(qf.validated_wide(spark, d), "temperature", "difference", 59, "1998-03-15", (-6.4, 0.0, 6.4))


# --- joins ----------------------------------------------------------------------------------------------------


@query(
    "J01_left_join_suffix",
    "SELECT d.ix, d.iy, d.doy, d.date, d.temperature, k.temperature AS temperature_historical FROM (SELECT *, CAST(dayofyear(date) AS INT) AS doy FROM daily) d LEFT JOIN (SELECT * FROM clim WHERE temperature_sd IS NOT NULL) k USING (ix, iy, doy)",
    "temperature temperature_historical",
)
def _(spark, d):
    daily = dates.with_date_parts(a.daily(spark, d).select("ix", "iy", "date", "temperature"), "date", ["doy"])
    clim = climatology.climatology(daily, ["temperature"], require_sd=True).drop("temperature_sd")
    return joins.join_suffix(daily, clim, ["ix", "iy", "doy"], "left", ("", "_historical"))


@query(
    "J02_right_join_calendar",
    "SELECT k.ix, k.iy, CAST(dayofyear(m.date) AS INT) AS doy, m.date FROM clim k RIGHT JOIN model_days m ON k.doy = dayofyear(m.date)",
)
def _(spark, d):
    clim = climatology.climatology(a.daily(spark, d), ["temperature"]).select("ix", "iy", "doy")
    days = calendar_side(dates.with_date_parts(a.model_days(spark, d), "date", ["doy"]))
    hits = clim.join(days, "doy").select("ix", "iy", "doy", "date")  # the calendar is the side that travels
    bare = days.join(F.broadcast(clim.select("doy").distinct()), "doy", "left_anti")  # at most 366 days
    return hits.unionByName(bare, allowMissingColumns=True)


@query(
    "J03_join_suffix_pair",
    "SELECT f.ix, f.iy, f.month, f.year, f.base_date AS base_date_historical, g.base_date AS base_date_forecast, f.temperature AS temperature_historical, g.temperature AS temperature_forecast "
    "FROM (SELECT ix, iy, month, year, base_date, temperature FROM forecast WHERE lead_month = month) f LEFT JOIN (SELECT ix, iy, lead_month AS month, lead_year AS year, base_date, temperature FROM forecast) g USING (ix, iy, month, year)",
    "temperature_historical temperature_forecast",
)
def _(spark, d):
    fc = forecast.normalize_forecast(a.forecast_members(spark, d))
    left = fc.where("lead_month = month").select("ix", "iy", "month", "year", "base_date", "temperature")
    right = fc.select("ix", "iy", F.col("lead_month").alias("month"), F.col("lead_year").alias("year"), "base_date", "temperature")
    return joins.join_suffix(left, right, ["ix", "iy", "month", "year"], "left", ("_historical", "_forecast"))


@query("J04_inner_join_common", "SELECT * FROM (SELECT ix, iy, unit FROM layers) JOIN (SELECT ix, iy, price FROM layers WHERE small IS NOT NULL) USING (ix, iy)", "price")
def _(spark, d):
    l = a.layers(spark, d)
    left, right = l.select("ix", "iy", "unit"), l.where("small IS NOT NULL").select("ix", "iy", "price")
    return left.join(right, joins.shared_columns(left, right), "inner")


@query(
    "J05_full_join",
    "SELECT ix, iy, date, r.cases, d.temperature FROM (SELECT ix, iy, date, sum(cases) AS cases FROM response GROUP BY 1, 2, 3) r FULL JOIN (SELECT ix, iy, date, temperature FROM daily) d USING (ix, iy, date)",
    "cases temperature",
)
def _(spark, d):
    r = events.outbreak_response(a.outbreaks(spark, d), a.grid_spec(spark, d), a.model_days(spark, d), a.RESPONSE_BREAKS)
    r = r.groupBy("ix", "iy", "date").agg(F.sum("cases").alias("cases"))
    return r.join(a.daily(spark, d).select("ix", "iy", "date", "temperature"), ["ix", "iy", "date"], "full")


@query("J06_natural_join", "SELECT * FROM (SELECT ix, iy, date, temperature FROM daily) NATURAL JOIN soil NATURAL JOIN (SELECT ix, iy, unit FROM layers)", "temperature")
def _(spark, d):
    return joins.natural_join([a.daily(spark, d).select("ix", "iy", "date", "temperature"), qf.soil(spark, d), a.layers(spark, d).select("ix", "iy", "unit")])


@query(
    "J07_union_or_natural",
    "SELECT 'stacked' AS kind, ix, iy, economy AS glw_cattle, NULL::BIGINT AS glw_sheep FROM layers UNION ALL SELECT 'stacked', ix, iy, small, NULL FROM layers UNION ALL SELECT 'joined', ix, iy, economy, small FROM layers",
)
def _(spark, d):
    l = a.layers(spark, d)
    same = joins.union_or_natural([l.select("ix", "iy", F.col(c).alias("glw_cattle")) for c in ("economy", "small")])
    differ = joins.union_or_natural(qf.livestock(spark, d))
    out = same.withColumn("kind", F.lit("stacked")).unionByName(differ.withColumn("kind", F.lit("joined")), allowMissingColumns=True)
    return out.select("kind", "ix", "iy", "glw_cattle", "glw_sheep")


@query("J08_reduce_left_join", "SELECT d.ix, d.iy, d.date, l.unit, s.soil_drainage FROM daily d LEFT JOIN layers l USING (ix, iy) LEFT JOIN soil s USING (ix, iy)")
def _(spark, d):
    frames = [a.daily(spark, d).select("ix", "iy", "date"), a.layers(spark, d).select("ix", "iy", "unit"), qf.soil(spark, d).select("ix", "iy", "soil_drainage")]
    return joins.join_all(frames, ["ix", "iy"])


@query("J09_join_band_tables", "SELECT ix, iy, economy, small, large FROM layers")
def _(spark, d):
    l = a.layers(spark, d)
    return joins.join_all([l.select("ix", "iy", b) for b in ("economy", "small", "large")], ["ix", "iy"])


@query("J10_join_or_zero", "SELECT g.ix, g.iy, m.date, coalesce(r.cases, 0) AS cases FROM grid g CROSS JOIN model_days m LEFT JOIN (SELECT * FROM response WHERE forecast_interval = 30) r USING (ix, iy, date)", "cases")
def _(spark, d):
    from ..operators.grid import with_dates

    spec = a.grid_spec(spark, d)
    dense = with_dates(spec.cells(spark).select("ix", "iy"), a.model_days(spark, d))
    r = events.outbreak_response(a.outbreaks(spark, d), spec, a.model_days(spark, d), (1, 30))
    return joins.join_or_zero(dense, r.select("ix", "iy", "date", "cases"), ["ix", "iy", "date"], ["cases"])


@query("J11_lookup_join", "SELECT l.ix, l.iy, k.drainage, k.texture FROM layers l LEFT JOIN soil_key k USING (unit)")
def _(spark, d):
    return a.layers(spark, d).select("ix", "iy", "unit").join(a.soil_key(spark, d), "unit", "left").drop("unit")


cte("ob_touching", a.inside_sql("ob_places", "longitude latitude", "longitude", "latitude"))


@query("J12_points_in_regions", "SELECT o.outbreak_id, t.region FROM outbreaks o JOIN ob_touching t USING (longitude, latitude)")
def _(spark, d):
    from ..operators.regions import match_points

    out = match_points(a.outbreaks(spark, d), a.regions(spark, d), "longitude", "latitude")
    return out.select("outbreak_id", "region")


@query("J13_points_intersecting_aggregate", "SELECT t.region, count(*) AS n, sum(o.cases)::BIGINT AS cases FROM outbreaks o JOIN ob_touching t USING (longitude, latitude) GROUP BY 1")
def _(spark, d):
    from ..operators.regions import match_points

    out = match_points(a.outbreaks(spark, d), a.regions(spark, d), "longitude", "latitude", tile=0.25)
    return out.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("cases").alias("cases"))


def _lag_sql(fn: str) -> str:
    return "SELECT e.user_id, e.event_id, CAST(e.ts AS DATE) AS date, " + ", ".join(
        f"(SELECT {fn}(p.value) FROM events p WHERE p.user_id = e.user_id AND CAST(p.ts AS DATE) BETWEEN CAST(e.ts AS DATE) - {i * 5} AND CAST(e.ts AS DATE) - {(i - 1) * 5 + 1}) AS value_lag_{i * 5}"
        for i in (1, 2)
    ) + " FROM events e"


def _event_lags(spark, d, fn):
    ev = a.table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("date"), "value")
    return windows.interval_lags(ev, ["value"], 5, 2, group_cols=["user_id"], agg=fn).drop("value")


@query("J14_correlated_range_lag", _lag_sql("avg"), "value_lag_5 value_lag_10")
def _(spark, d):
    return _event_lags(spark, d, "avg")


@query("J15_interval_join", "SELECT ix, iy, date, forecast_interval, forecast_start, forecast_end FROM response")
def _(spark, d):
    out = events.outbreak_response(a.outbreaks(spark, d), a.grid_spec(spark, d), a.model_days(spark, d), a.RESPONSE_BREAKS)
    return out.drop("cases")


@query("J16_fixed_window_join", "SELECT m.date, t.region, TRUE AS outbreak_7 FROM (SELECT DISTINCT region, start_date FROM outbreaks JOIN ob_within USING (longitude, latitude)) t JOIN model_days m ON t.start_date - m.date BETWEEN 2 AND 7 GROUP BY 1, 2")
def _(spark, d):
    return events.outbreak_flag(a.outbreaks(spark, d), a.regions(spark, d), a.model_days(spark, d), 2, 7)


@query(
    "J17_asof_issue",
    "SELECT d.date, i.base_date FROM (SELECT DISTINCT date FROM daily) d ASOF JOIN (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) + 9 AS base_date FROM orders) i ON d.date >= i.base_date",
)
def _(spark, d):
    issues = a.table(spark, d, "orders").select(F.date_add(F.trunc(F.to_date("o_orderdate"), "MM"), 9).alias("base_date"))
    return joins.latest_at_or_before(a.daily(spark, d), issues)


@query(
    "J18_previous_available",
    "SELECT m.date, max(CASE WHEN e.date < m.date - 1 THEN e.date END) AS before_1, max(CASE WHEN e.date < m.date - 31 THEN e.date END) AS before_31, max(CASE WHEN e.date < m.date - 61 THEN e.date END) AS before_61 FROM model_days m CROSS JOIN model_days e GROUP BY 1",
)
def _(spark, d):
    return joins.previous_available(a.model_days(spark, d), [1, 31, 61])


@query(
    "J19_nearest_fill",
    """SELECT h.ix, h.iy, coalesce(h.drainage, (SELECT k.drainage FROM unit_cells k WHERE k.drainage IS NOT NULL
      ORDER BY (h.ix - k.ix) * (h.ix - k.ix) + (h.iy - k.iy) * (h.iy - k.iy), k.ix, k.iy LIMIT 1)) AS drainage FROM unit_cells h""",
)
def _(spark, d):
    from ..operators.nearest import fill_nearest

    units = a.layers(spark, d).select("ix", "iy", "unit").join(a.soil_key(spark, d), "unit", "left")
    return fill_nearest(units.select("ix", "iy", "drainage"), ["drainage"])


cte("unit_cells", "SELECT ix, iy, drainage FROM layers LEFT JOIN soil_key USING (unit)")


@query("J20_cells_within_distance", "SELECT ix, iy, outbreak_id, exp(-1e-2 * km) AS w FROM near_events", "w")
def _(spark, d):
    out = events.distance_weights(a.outbreaks(spark, d), a.grid_spec(spark, d), within_km=500.0)
    return out.select("ix", "iy", "outbreak_id", "w")


@query("J21_grid_of_parameters", "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, m.month, o_orderstatus AS product FROM orders CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS month) m")
def _(spark, d):
    o = a.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("product")).distinct()
    return o.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


@query("J22_semi_join", "SELECT ix, iy, date, temperature FROM daily WHERE date IN (SELECT date FROM model_days)", "temperature")
def _(spark, d):
    return a.daily(spark, d).select("ix", "iy", "date", "temperature").join(calendar_side(a.model_days(spark, d)), "date", "left_semi")


@query("J23_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    urgent = a.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return a.table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


# --- aggregates -----------------------------------------------------------------------------------------------


@query("A01_grouped_means_by_pattern", "SELECT ix, iy, avg(temperature) AS temperature, avg(relative_humidity) AS relative_humidity FROM daily GROUP BY 1, 2", "temperature relative_humidity")
def _(spark, d):
    df = a.daily(spark, d)
    return df.groupBy("ix", "iy").agg(*agg.means(columns.columns_matching(df, "temperature|humidity")))


@query("A02_grouped_sd", "SELECT ix, iy, avg(precipitation) AS precipitation, stddev_samp(precipitation) AS precipitation_sd FROM daily GROUP BY 1, 2", "precipitation precipitation_sd")
def _(spark, d):
    return a.daily(spark, d).groupBy("ix", "iy").agg(*agg.means_and_sds(["precipitation"]))


@query("A03_mean_with_defined_sd", "SELECT user_id, avg(value) AS value, stddev_samp(value) AS value_sd FROM events WHERE event_type = 'error' GROUP BY 1 HAVING stddev_samp(value) IS NOT NULL", "value value_sd")
def _(spark, d):
    ev = a.table(spark, d, "events").where("event_type = 'error'")
    return ev.groupBy("user_id").agg(*agg.means_and_sds(["value"])).where("value_sd IS NOT NULL")


@query("A04_poisoning_mean", "SELECT ix, date, CASE WHEN count(relative_humidity) = count(*) THEN avg(relative_humidity) END AS relative_humidity FROM daily GROUP BY 1, 2", "relative_humidity")
def _(spark, d):
    return a.daily(spark, d).groupBy("ix", "date").agg(*agg.means(["relative_humidity"], na_rm=False))


@query("A05_five_numbers", "SELECT l_returnflag, avg(l_tax) AS mean, stddev_samp(l_tax) AS sd, min(l_tax) AS min, max(l_tax) AS max, max(l_tax) - min(l_tax) AS range FROM lineitem GROUP BY 1", "mean sd min max range")
def _(spark, d):
    return a.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*agg.five_numbers("l_tax"))


@query(
    "A06_two_level_aggregate",
    "SELECT ix, iy, " + ", ".join(f"avg({s}) AS temperature_{s}" for s in ("mean", "sd", "min", "max", "range"))
    + " FROM (SELECT ix, iy, year(date) AS y, avg(temperature) AS mean, stddev_samp(temperature) AS sd, min(temperature) AS min, max(temperature) AS max, max(temperature) - min(temperature) AS range FROM daily GROUP BY 1, 2, 3) GROUP BY 1, 2",
    " ".join(f"temperature_{s}" for s in ("mean", "sd", "min", "max", "range")),
)
def _(spark, d):
    return climatology.yearly_summary(a.daily(spark, d), "temperature")


@query("A07_sum_without_missing", "SELECT ix, iy, start_date, coalesce(sum(cases), 0)::BIGINT AS cases FROM outbreaks GROUP BY 1, 2, 3")
def _(spark, d):
    ob = a.grid_spec(spark, d).snap(a.outbreaks(spark, d))
    return ob.groupBy("ix", "iy", "start_date").agg(agg.total(F.col("cases")).alias("cases"))


@query(
    "A08_mode",
    "SELECT p_brand, p_type AS mode_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)) WHERE rn = 1",
)
def _(spark, d):
    return a.table(spark, d, "part").groupBy("p_brand").agg(agg.aggregate_named("mode")(F.col("p_type")).alias("mode_type"))


@query(
    "A08_mode_two_step",
    "SELECT c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE rn = 1",
)
def _(spark, d):
    from ..operators.grid import most_frequent

    return most_frequent(a.table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query(
    "A09_spec_driven",
    "SELECT l_linestatus, l_returnflag, avg(l_tax) AS l_tax_avg, sum(l_quantity) AS l_quantity_sum, (SELECT l_linenumber FROM (SELECT l_linenumber, count(*) AS n FROM lineitem m WHERE m.l_linestatus = l.l_linestatus AND m.l_returnflag = l.l_returnflag GROUP BY 1) ORDER BY n DESC, l_linenumber LIMIT 1) AS l_linenumber_mode FROM lineitem l GROUP BY 1, 2",
    "l_tax_avg l_quantity_sum",
)
def _(spark, d):
    spec = {"l_linestatus": None, "l_returnflag": None, "l_tax": "AVG", "l_quantity": "SUM", "l_linenumber": "MODE"}
    keys, aggs = agg.spec_aggregates(spec)
    return a.table(spark, d, "lineitem").groupBy(*keys).agg(*aggs)


for _fn in ("sum", "min", "max", "count"):

    @query(f"A11_lag_{_fn}", _lag_sql(_fn), "" if _fn == "count" else "value_lag_5 value_lag_10")
    def _(spark, d, fn=_fn):
        return _event_lags(spark, d, fn)


@query("A12_weighted_mean", "SELECT l_suppkey, sum(l_tax * l_quantity) / sum(l_quantity) AS tax FROM lineitem GROUP BY 1", "tax")
def _(spark, d):
    return a.table(spark, d, "lineitem").groupBy("l_suppkey").agg(agg.weighted_mean(F.col("l_tax"), F.col("l_quantity")).alias("tax"))


@query("A13_ensemble", "SELECT ix, iy, base_date, lead_months, forecast_end_date, variable, units, mean * CASE WHEN variable = 'precipitation' THEN 1e9 ELSE 1 END AS mean, sd * CASE WHEN variable = 'precipitation' THEN 1e9 ELSE 1 END AS sd FROM ensemble", "mean sd")
def _(spark, d):
    out = forecast.ensemble_stats(a.forecast_members(spark, d))
    scale = F.when(F.col("variable") == "precipitation", 1e9).otherwise(1.0)
    return out.withColumns({"mean": F.col("mean") * scale, "sd": F.col("sd") * scale})


@query("A14_counts_per_group", "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return a.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("A15_global_range", "SELECT least(min(l_tax), min(l_discount)) AS min, greatest(max(l_tax), max(l_discount)) AS max FROM lineitem", "min max")
def _(spark, d):
    return a.table(spark, d, "lineitem").agg(*agg.global_range(["l_tax", "l_discount"]))


@query("A18_quantiles", "SELECT quantile_cont(o_totalprice, 1e-2) AS q01, quantile_cont(o_totalprice, 99e-2) AS q99 FROM orders", "q01 q99")
def _(spark, d):
    """The display domain: exact 1 % and 99 % quantiles from ordered counts."""
    return ranks.quantiles(a.table(spark, d, "orders"), "o_totalprice", [0.01, 0.99]).toDF("q01", "q99")


@query("A19_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1")
def _(spark, d):
    return a.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_orderdate").alias("days"))


@query("A20_row_sum", "SELECT ix, iy, CAST(coalesce(economy, 0) + coalesce(small, 0) + coalesce(large, 0) AS DOUBLE) AS total FROM layers", "total")
def _(spark, d):
    return a.layers(spark, d).select("ix", "iy", columns.row_sum(["economy", "small", "large"]).alias("total"))


@query("A21_keep_latest", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1")
def _(spark, d):
    return windows.keep_latest(a.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


# --- windows --------------------------------------------------------------------------------------------------

cte("user_days", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS start_date FROM events")


def _user_days(spark, d):
    return a.table(spark, d, "events").select("user_id", F.to_date("ts").alias("start_date")).distinct()


@query("W01_interval_ends", "SELECT user_id, start_date, coalesce(lead(start_date) OVER (PARTITION BY user_id ORDER BY start_date) - 1, start_date + 15) AS end_date FROM user_days")
def _(spark, d):
    return windows.interval_ends(_user_days(spark, d), within=["user_id"])


@query("W02_interval_ends_from_completion", "SELECT user_id, start_date, coalesce(lead(start_date) OVER (PARTITION BY user_id ORDER BY start_date) - 1, last_day(start_date)) AS end_date FROM user_days")
def _(spark, d):
    return windows.interval_ends(_user_days(spark, d), within=["user_id"], last=F.last_day("start_date"))


@query(
    "W03_interval_gaps",
    "SELECT user_id, start_date, end_date, nxt - start_date AS start_diff, end_date - nxt AS overlap, end_date - nxt < -1 AS has_gap, end_date - nxt > 0 AS has_overlap FROM (SELECT *, start_date + 2 AS end_date, lead(start_date) OVER (PARTITION BY user_id ORDER BY start_date) AS nxt FROM user_days)",
)
def _(spark, d):
    days = _user_days(spark, d).withColumn("end_date", F.date_add("start_date", 2))
    return climatology.reported_overlaps(days, ["user_id"]).withColumns({c: F.col(c).cast("long") for c in ("start_diff", "overlap")})


@query("W04_day_range_frame", "SELECT ix, iy, date, (SELECT sum(p.precipitation) FROM daily p WHERE p.ix = d.ix AND p.iy = d.iy AND p.date BETWEEN d.date - 30 AND d.date - 1) AS precipitation_lag_30 FROM daily d", "precipitation_lag_30")
def _(spark, d):
    df = a.daily(spark, d).select("ix", "iy", "date", "precipitation")
    return windows.interval_lags(df, ["precipitation"], 30, 1, agg="sum").drop("precipitation")


@query("W05_surrogate_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_totalprice, o_orderkey) AS id FROM orders")
def _(spark, d):
    out = ranks.row_numbers(a.table(spark, d, "orders"), ["o_orderdate", "o_totalprice", "o_orderkey"], "id")
    return out.select("o_orderkey", F.col("id").cast("long").alias("id"))


@query("W06_group_id", "SELECT DISTINCT p_brand, p_type, dense_rank() OVER (ORDER BY p_brand, p_type) AS group_id FROM part")
def _(spark, d):
    """Dense ids of the distinct groups, then one row per group."""
    groups = a.table(spark, d, "part").select("p_brand", "p_type").distinct()
    out = ranks.row_numbers(groups, ["p_brand", "p_type"], "group_id")
    return out.withColumn("group_id", F.col("group_id").cast("long"))


@query("W07_group_min_and_size", "SELECT user_id, event_id, min(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS first_day, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def _(spark, d):
    ev = a.table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return windows.with_group_stats(ev, ["user_id"], first_day=F.min("day"), n=F.count(F.lit(1))).drop("day")


@query("W08_running_count", "SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS running FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def _(spark, d):
    daily = a.table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return ranks.running_totals(daily, ["day"], {"running": "n"}, ["user_id"])


@query("W10_batches", "SELECT CAST(floor((rn - 1) / 10) + 1 AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) GROUP BY 1")
def _(spark, d):
    out = ranks.batch_numbers(a.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 10)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("W11_adjacent_breaks", "SELECT lo, hi, count(*) AS n FROM (VALUES (1, 10), (10, 20), (20, 51)) AS b(lo, hi) JOIN part ON p_size >= lo AND p_size < hi GROUP BY 1, 2")
def _(spark, d):
    """Parts per half-open size class."""
    sizes = a.table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    spans = dates.interval_table(spark, (1, 10, 20, 51)).withColumn("p_size", F.explode(F.expr("sequence(lo, hi - 1)")))
    return sizes.join(spans, "p_size").groupBy("lo", "hi").agg(F.sum("n").alias("n"))


# --- sort, limit, sampling ------------------------------------------------------------------------------------


@query("O01_order_by", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def _(spark, d):
    return a.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", F.desc("o_orderdate"), "o_orderkey")


@query("O02_top_one", "SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def _(spark, d):
    return a.table(spark, d, "orders").select("o_orderdate", "o_orderkey").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1)


def _sampled_sql(days: str, n: int, seed: int) -> str:
    """The ``n`` days of each month whose seeded hash comes first."""
    return f"""(SELECT date FROM (SELECT date, row_number() OVER (PARTITION BY year(date), month(date)
      ORDER BY md5(strftime(date, '%Y-%m-%d') || ':{seed}'), date) AS r FROM (SELECT DISTINCT date FROM {days})) WHERE r <= {n})"""


_SHIPPED = "(SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)"


@query("O04_sample_days_per_month", f"SELECT date, quantity FROM {_sampled_sql(_SHIPPED, 3, 212)} JOIN {_SHIPPED} USING (date)", "quantity")
def _(spark, d):
    """Three of the shipped days of each month, by seeded hash, with that day's quantity."""
    li = a.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("quantity"))
    return windows.sample_days(li, 3, 212).join(li, "date")


@query("O07_one_random_date", f"SELECT date FROM {_sampled_sql(_SHIPPED, 1, 5)}")
def _(spark, d):
    """One of the shipped days of each month."""
    return windows.sample_days(a.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")), 1, 5)


@query("O05_random_tie_break", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, md5(o_custkey || ':7'), o_custkey LIMIT 1")
def _(spark, d):
    """One of the customers with the most orders, chosen by hash among ties."""
    n = a.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    draw = F.md5(F.concat_ws(":", F.col("o_custkey").cast("string"), F.lit("7")).cast("binary"))
    return n.orderBy(F.desc("n"), draw, "o_custkey").limit(1)


@query("O06_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
def _(spark, d):
    return a.table(spark, d, "orders").orderBy("o_totalprice", "o_orderkey").select("o_orderkey").offset(20).limit(10)


# --- set operators --------------------------------------------------------------------------------------------


@query("U01_union_all", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def _(spark, d):
    return a.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).unionByName(a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("U02_bind_rows", "SELECT c_custkey AS k, c_acctbal AS bal, NULL AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier", "bal")
def _(spark, d):
    c = a.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("U03_columns_side_by_side", "SELECT outbreak_id, ix, iy, 20 + (ix + 5e-1) * 5e-1 AS x, -10 + (iy + 5e-1) * 5e-1 AS y FROM outbreaks", "x y")
def _(spark, d):
    """Cell and cell centre next to each event, in one projection."""
    spec = a.grid_spec(spark, d)
    return spec.with_centres(spec.snap(a.outbreaks(spark, d))).select("outbreak_id", "ix", "iy", "x", "y")


@query("U04_set_difference", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _(spark, d):
    return a.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(a.table(spark, d, "supplier").select("s_nationkey"))


@query("U05_intersect", "SELECT ix, iy, date FROM daily INTERSECT SELECT ix, iy, start_date FROM outbreaks")
def _(spark, d):
    ob = a.grid_spec(spark, d).snap(a.outbreaks(spark, d)).select("ix", "iy", "start_date")
    return a.daily(spark, d).select("ix", "iy", "date").intersect(ob)


# --- reshape --------------------------------------------------------------------------------------------------


@query(
    "R01_pivot_wider",
    "SELECT ix, iy, base_date, lead_months, max(CASE WHEN variable = 'temperature' THEN mean END) AS temperature_mean, max(CASE WHEN variable = 'temperature' THEN sd END) AS temperature_sd, max(CASE WHEN variable = 'dewpoint' THEN mean END) AS dewpoint_mean, max(CASE WHEN variable = 'dewpoint' THEN sd END) AS dewpoint_sd FROM ensemble GROUP BY 1, 2, 3, 4",
    "temperature_mean temperature_sd dewpoint_mean dewpoint_sd",
)
def _(spark, d):
    stats = forecast.ensemble_stats(a.forecast_members(spark, d))
    return stats.groupBy("ix", "iy", "base_date", "lead_months").pivot("variable", ["temperature", "dewpoint"]).agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"))


@query("R02_pivot_names", "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
def _(spark, d):
    return a.table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("R03_pivot_longer", "UNPIVOT (SELECT ix, iy, date, temperature, precipitation FROM daily) ON temperature, precipitation INTO NAME variable VALUE value", "value")
def _(spark, d):
    return a.daily(spark, d).unpivot(["ix", "iy", "date"], ["temperature", "precipitation"], "variable", "value")


@query(
    "R04_pivot_longer_regex",
    "SELECT ix, iy, date, doy, month, year, 'recent' AS time_frame, outbreak_history_weight_recent AS weight FROM history UNION ALL SELECT ix, iy, date, doy, month, year, 'old', outbreak_history_weight_old FROM history",
    "weight",
)
def _(spark, d):
    return events.history_long(qf.history(spark, d))


@query("R05_repeat_days", "SELECT user_id, start_date, CAST(start_date + CAST(k AS INT) AS DATE) AS date FROM user_days, (SELECT unnest(range(4)) AS k)")
def _(spark, d):
    days = _user_days(spark, d).withColumn("end_date", F.date_add("start_date", 3))
    return dates.expand_range(days, "start_date", "end_date").drop("end_date")


@query("R06_clipped_date_lists", "SELECT satellite, start_date, count(*) AS days, min(date) AS first_day, max(date) AS last_day FROM lookup_days GROUP BY 1, 2")
def _(spark, d):
    comp = a.composites(spark, d)
    primary = comp.where("source = 'sentinel'").select("start_date", F.date_add("start_date", 9).alias("end_date"))
    lookup, _ = climatology.composite_date_lookup(primary, comp.where("source = 'modis'"))
    return lookup.select("satellite", "start_date", F.size("lookup_dates").cast("long").alias("days"), F.array_min("lookup_dates").alias("first_day"), F.array_max("lookup_dates").alias("last_day"))


@query("R07_unnest", "SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[CAST(i + 1 AS INT)] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE i < len(embedding)", "v")
def _(spark, d):
    return a.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query("R08_packed_parameters", "SELECT CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month, v AS variable, count(o_orderkey) AS orders FROM (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS DATE) AS m) CROSS JOIN (VALUES ('2m_temperature'), ('total_precipitation')) AS t(v) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY 1, 2, 3")
def _(spark, d):
    """Monthly request parameters with list columns, unpacked and matched with the orders of the month."""
    o = a.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_orderkey", F.to_date("o_orderdate").alias("d"))
    lo, hi = o.agg(F.min(F.trunc("d", "MM")), F.max("d")).first()
    months = readers.parameter_table(spark, str(lo), str(hi), {"variables": ["2m_temperature", "total_precipitation"], "leadtime_months": ["1", "2"]})
    out = months.select("year", "month", F.explode("variables").alias("variable")).join(o, ["year", "month"], "left")
    return out.groupBy("year", "month", "variable").agg(F.count("o_orderkey").alias("orders"))


@query("R09_date_spine", "SELECT CAST(u.day AS DATE) AS date, count(o_orderkey) AS n FROM unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 7 DAY)) AS u(day) LEFT JOIN orders ON o_orderdate = u.day GROUP BY 1")
def _(spark, d):
    o = a.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderkey")
    lo, hi = o.agg(F.min("date"), F.max("date")).first()
    return dates.spine(spark, str(lo), str(hi), "7 day").join(o, "date", "left").groupBy("date").agg(F.count("o_orderkey").alias("n"))


# --- scalar functions -----------------------------------------------------------------------------------------


@query(
    "F01_F05_date_parts",
    """SELECT l_orderkey, l_linenumber, CAST(dayofyear(l_shipdate) AS INT) AS doy, CAST(month(l_shipdate) AS INT) AS month, CAST(year(l_shipdate) AS INT) AS year, CAST(day(l_shipdate) AS INT) AS day,
      CAST(l_shipdate AS DATE) - 30 AS before, CAST(l_shipdate AS DATE) + 15 AS after, make_date(year(l_shipdate), month(l_shipdate), 1) AS made,
      strftime(l_shipdate, '%Y-%m') AS ym, strftime(l_shipdate, '%m-%d-%Y') AS mdy, strftime(l_shipdate, '%Y%m%d') AS ymd,
      CAST(date_trunc('month', l_shipdate) AS DATE) AS floor_month, last_day(CAST(l_shipdate AS DATE)) AS last_day, CAST(day(last_day(CAST(l_shipdate AS DATE))) AS INT) AS days FROM lineitem""",
)
def _(spark, d):
    df = a.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"))
    df = dates.with_date_parts(df, "date", ["doy", "month", "year", "day"])
    return df.withColumns(
        {
            "before": F.date_sub("date", 30),
            "after": F.date_add("date", 15),
            "made": F.make_date("year", "month", F.lit(1)),
            "ym": F.date_format("date", "yyyy-MM"),
            "mdy": F.date_format("date", "MM-dd-yyyy"),
            "ymd": F.date_format("date", "yyyyMMdd"),
            "floor_month": F.trunc("date", "MM"),
            "last_day": F.last_day("date"),
            "days": dates.days_in_month(F.col("date")),
        }
    ).drop("date")


@query("F03_parse_year_day", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def _(spark, d):
    text = F.date_format(F.to_date("o_orderdate"), "yyyyDDD")
    return a.table(spark, d, "orders").select("o_orderkey", dates.date_of_year_day(text).alias("date"))


@query(
    "F06_F08_durations",
    """SELECT o_orderkey, CAST(floor((year(DATE '2002-01-01') - year(o_orderdate)) * 12 + 1 - month(o_orderdate) - CASE WHEN day(o_orderdate) > 1 THEN 1 ELSE 0 END) AS INT) AS months,
      (DATE '2002-01-01' - CAST(o_orderdate AS DATE)) / 36525e-2 AS years, CAST(o_orderdate AS DATE) AS from_epoch FROM orders""",
    "years",
)
def _(spark, d):
    day, end = F.to_date("o_orderdate"), F.lit("2002-01-01").cast("date")
    epoch = F.to_date(F.timestamp_seconds(F.unix_date(day).cast("long") * 86400))
    return a.table(spark, d, "orders").select("o_orderkey", dates.whole_months(day, end).alias("months"), dates.years_between(day, end).alias("years"), epoch.alias("from_epoch"))


@query(
    "F09_F13_climate_functions",
    """SELECT l_orderkey, l_linenumber, 28e1 + l_quantity - 27315e-2 AS celsius, CASE WHEN l_tax - 4e-2 > 0 THEN (l_tax - 4e-2) * 1e-6 * 864e5 ELSE 0 END AS mm,
      100 * exp(17625e-3 * l_tax * 100 / (24304e-2 + l_tax * 100)) / exp(17625e-3 * l_quantity / (24304e-2 + l_quantity)) AS rh,
      CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1e4 ELSE l_extendedprice / 2e2 END AS scaled,
      exp(-5e-1 * l_discount) * log10(l_quantity + 1) AS decay FROM lineitem""",
    "celsius mm rh scaled decay",
)
def _(spark, d):
    li = a.table(spark, d, "lineitem")
    source = F.when(F.col("l_returnflag") == "R", "modis").otherwise("sentinel")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        climate.kelvin_to_celsius(280.0 + F.col("l_quantity")).alias("celsius"),
        climate.rate_to_mm_per_day((F.col("l_tax") - 0.04) * 1e-6).alias("mm"),
        climate.relative_humidity(F.col("l_quantity"), F.col("l_tax") * 100).alias("rh"),
        climate.scale_by_source(F.col("l_extendedprice"), source).alias("scaled"),
        (F.exp(-0.5 * F.col("l_discount")) * F.log10(F.col("l_quantity") + 1)).alias("decay"),
    )


@query("F11_humidity_sd", "SELECT ix, iy, base_date, lead_month, relative_humidity, relative_humidity_sd FROM forecast", "relative_humidity relative_humidity_sd")
def _(spark, d):
    return forecast.normalize_forecast(a.forecast_members(spark, d)).select("ix", "iy", "base_date", "lead_month", "relative_humidity", "relative_humidity_sd")


@query(
    "F14_great_circle",
    "SELECT outbreak_id, 2 * 63710088e-4 * asin(least(1, sqrt(pow(sin(radians(-5 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(-5)) * pow(sin(radians(25 - longitude) / 2), 2)))) AS km FROM outbreaks",
    "km",
)
def _(spark, d):
    return a.outbreaks(spark, d).select("outbreak_id", geo.haversine_km(F.col("longitude"), F.col("latitude"), F.lit(25.0), F.lit(-5.0)).alias("km"))


@query(
    "F15_F19_conditionals_and_recodes",
    """SELECT outbreak_id, coalesce(cases, -1) AS cases, least(cases, 3) AS capped, cases IS NULL AS unknown,
      CASE WHEN cases IS NULL THEN 'UNK' WHEN cases = 5 THEN '1' ELSE '0' END AS texture, CASE WHEN cases > 3 THEN 'high' WHEN cases > 0 THEN 'low' ELSE 'none' END AS level FROM outbreaks""",
)
def _(spark, d):
    c = F.col("cases")
    return a.outbreaks(spark, d).select(
        "outbreak_id",
        F.coalesce(c, F.lit(-1)).alias("cases"),
        F.least(c, F.lit(3)).alias("capped"),
        c.isNull().alias("unknown"),
        columns.recode(c, {5: "1"}, default="0", missing="UNK").alias("texture"),
        F.when(c > 3, "high").when(c > 0, "low").otherwise("none").alias("level"),
    )


@query("F17_F18_soil_recodes", "SELECT unit, CASE WHEN drainage = 'E' THEN 1 WHEN drainage = 'SE' THEN 2 WHEN drainage = 'W' THEN 3 WHEN drainage = 'MW' THEN 4 WHEN drainage = 'I' THEN 5 WHEN drainage = 'P' THEN 6 WHEN drainage = 'VP' THEN 7 END AS ordinal, CASE WHEN texture IS NULL THEN 'UNK' WHEN texture IN (7) THEN '2' WHEN texture = 5 THEN '1' WHEN texture = 8 THEN '3' WHEN texture = 9 THEN '4' WHEN texture = 10 THEN '5' WHEN texture = 11 THEN '6' WHEN texture = 12 THEN '7' ELSE '0' END AS grp FROM soil_key")
def _(spark, d):
    from ..plans.districts import DRAINAGE_ORDER
    from ..plans.layers import TEXTURE_GROUPS

    return a.soil_key(spark, d).select("unit", columns.recode(F.col("drainage"), DRAINAGE_ORDER).alias("ordinal"), columns.recode(F.col("texture"), TEXTURE_GROUPS, "0", "UNK").alias("grp"))


@query("F20_country_lookup", "SELECT n_name AS country, 'N' || n_nationkey AS iso_code, r_name AS continent, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def _(spark, d):
    codes = qf.country_codes(spark, d)
    c = a.table(spark, d, "customer").select(F.upper(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("iso_code"))
    return c.join(codes, "iso_code").groupBy("country", "iso_code", "continent").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "F21_F22_text",
    """SELECT p_partkey, regexp_matches(p_name, '^(blue|red)') AS is_colour, regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS number, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS plain,
      string_split(p_name, ' ')[1] AS first_word, upper(p_name) AS upper_name, lpad(CAST(p_size AS VARCHAR), 3, '0') AS padded, p_brand || '_to_' || p_type AS glued FROM part""",
)
def _(spark, d):
    return a.table(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").rlike("^(blue|red)").alias("is_colour"),
        F.regexp_extract("p_brand", "Brand#([0-9]+)", 1).alias("number"),
        F.regexp_replace("p_brand", "[^A-Za-z0-9]", "").alias("plain"),
        F.split("p_name", " ")[0].alias("first_word"),
        F.upper("p_name").alias("upper_name"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("padded"),
        F.concat_ws("_to_", "p_brand", "p_type").alias("glued"),
    )


@query("F23_casts", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n, TRY_CAST(p_type AS INT) AS bad FROM part")
def _(spark, d):
    df = a.table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("n"), F.col("p_type").alias("bad"))
    return columns.cast_columns(df, ["n", "bad"], "int", lenient=True)


@query("F24_date_in_list", "SELECT satellite, start_date, bool_or(date = DATE '2024-01-15') AS serves FROM lookup_days GROUP BY 1, 2")
def _(spark, d):
    comp = a.composites(spark, d)
    primary = comp.where("source = 'sentinel'").select("start_date", F.date_add("start_date", 9).alias("end_date"))
    lookup, _ = climatology.composite_date_lookup(primary, comp.where("source = 'modis'"))
    return lookup.select("satellite", "start_date", F.array_contains("lookup_dates", F.lit("2024-01-15").cast("date")).alias("serves"))


@query("F25_json_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) + b AS k, event_type AS name FROM events, (VALUES (0), (1)) AS t(b)")
def _(spark, d):
    """Stored responses with an item array, to one row per item."""
    k = F.get_json_object("props", "$.k").cast("int")
    item = lambda v: F.struct(v.alias("k"), F.col("event_type").alias("name"))
    payload = F.to_json(F.struct(F.array(item(k), item(k + 1)).alias("value")))
    df = a.table(spark, d, "events").select("event_id", payload.alias("payload"))
    return readers.explode_payload(df, "payload", "value array<struct<k int, name string>>", "value", ["event_id"])


# --- function surface -----------------------------------------------------------------------------------------


@query("X01_user_mode", "SELECT ix, iy, soil_drainage FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY n DESC, soil_drainage) AS rn FROM (SELECT CAST(ix // 2 AS INT) AS ix, CAST(iy // 2 AS INT) AS iy, soil_drainage, count(*) AS n FROM soil GROUP BY ALL)) WHERE rn = 1")
def _(spark, d):
    halved = qf.soil(spark, d).withColumns({"ix": F.expr("cast(ix div 2 as int)"), "iy": F.expr("cast(iy div 2 as int)")})
    return halved.groupBy("ix", "iy").agg(agg.aggregate_named("MODE")(F.col("soil_drainage")).alias("soil_drainage"))


@query("X03_aggregate_by_name", "SELECT l_returnflag, sum(l_tax) AS sum, avg(l_tax) AS avg, min(l_tax) AS min, max(l_tax) AS max, stddev_samp(l_tax) AS sd, count(l_tax) AS count FROM lineitem GROUP BY 1", "sum avg min max sd")
def _(spark, d):
    names = ["sum", "avg", "min", "max", "sd", "count"]
    return a.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[agg.aggregate_named(n)(F.col("l_tax")).alias(n) for n in names])


@query("D27_natural_keys", "SELECT * FROM (SELECT ix, iy, date FROM daily) NATURAL JOIN (SELECT ix, iy FROM soil)")
def _(spark, d):
    return assemble.keys_by_natural_join([a.daily(spark, d).select("ix", "iy", "date"), qf.soil(spark, d).select("ix", "iy")])


@query("J20_cells_per_event", "SELECT outbreak_id, count(*) AS cells FROM near_events GROUP BY 1")
def _(spark, d):
    near = cells_within(a.outbreaks(spark, d), a.grid_spec(spark, d), 500.0)
    return near.groupBy("outbreak_id").agg(F.count(F.lit(1)).alias("cells"))


@query("P08_grid_extent", "SELECT ix, iy FROM outbreaks WHERE longitude < 22 GROUP BY 1, 2")
def _(spark, d):
    """Snapping to a grid that covers part of the points; points outside have no cell."""
    narrow = GridSpec.from_extent(20.0, 22.0, -10.0, -7.5, 0.5)
    return narrow.snap(a.outbreaks(spark, d)).where("ix IS NOT NULL").select("ix", "iy").distinct()
