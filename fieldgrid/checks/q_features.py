"""Checks of the composite operators (ids D1..D28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.regions import aggregate_by_region, mask_to_regions
from ..operators.windows import interval_ends, interval_lags
from ..plans import assemble, calendars, climatology, districts, events, forecast, layers
from ..session import cut
from . import adapters as a
from .registry import cte, query

ANOM = [f"anomaly_{k}{c}" for c in a.WEATHER for k in ("", "scaled_")]
FANOM = [f"anomaly_forecast_{k}{c}" for c in a.WEATHER for k in ("", "scaled_")]
STATS = [f"{c}{s}" for c in a.WEATHER for s in ("", "_sd")]


def veg_sources(spark, d):
    """Daily rows of both satellites: interval ends from the composite calendar, then the step function."""
    comp = a.composites(spark, d)
    days = interval_ends(comp.select("source", "start_date").distinct(), within=["source"])
    full = climatology.expand_composites(comp.join(days, ["source", "start_date"]))
    return {s: full.where(F.col("source") == s) for s in ("modis", "sentinel")}


cte(
    "fused",
    """SELECT ix, iy, date, CAST(dayofyear(date) AS INT) AS doy, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year,
      avg(CASE WHEN source = 'modis' THEN ndvi / 1e4 ELSE ndvi / 2e2 END) AS ndvi FROM veg_daily GROUP BY ALL""",
)


@query("D01_fuse_sources", "SELECT * FROM fused", "ndvi")
def _(spark, d):
    return climatology.fuse_sources(veg_sources(spark, d))


@query(
    "D02_expand_composites",
    """SELECT ix, iy, date, CAST(dayofyear(date) AS INT) AS doy, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year, source, ndvi FROM veg_daily""",
    "ndvi",
)
def _(spark, d):
    parts = veg_sources(spark, d)
    return parts["modis"].unionByName(parts["sentinel"])


cte(
    "lookup_days",
    """SELECT 'sentinel' AS satellite, k.start_date, CAST(u.day AS DATE) AS date
      FROM (SELECT start_date, coalesce(lead(start_date) OVER (ORDER BY start_date) - 1, start_date + 9) AS end_date
        FROM (SELECT DISTINCT start_date FROM composites WHERE source = 'sentinel')) k,
        unnest(generate_series(CAST(k.start_date AS TIMESTAMP), CAST(k.end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS u(day)
    UNION ALL
    SELECT 'modis', k.start_date, CAST(u.day AS DATE)
      FROM (SELECT start_date, lead(start_date) OVER (ORDER BY start_date) - 1 AS end_date
        FROM (SELECT DISTINCT start_date FROM composites WHERE source = 'modis')) k,
        unnest(generate_series(CAST(k.start_date AS TIMESTAMP), CAST(k.end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS u(day)
      WHERE CAST(u.day AS DATE) < (SELECT min(start_date) FROM composites WHERE source = 'sentinel')""",
)


@query("D03_composite_date_lookup", "SELECT satellite, start_date, date, CAST(dayofyear(date) AS INT) AS doy FROM lookup_days")
def _(spark, d):
    comp = a.composites(spark, d)
    primary = comp.where("source = 'sentinel'").select("start_date", F.date_add("start_date", 9).alias("end_date"))
    lookup, _ = climatology.composite_date_lookup(primary, comp.where("source = 'modis'"))
    pairs = F.arrays_zip(F.col("lookup_dates").alias("date"), F.col("lookup_day_of_year").alias("doy"))
    return lookup.select("satellite", "start_date", F.inline(pairs))


@query("D04_climatology", "SELECT * FROM clim", " ".join(STATS))
def _(spark, d):
    return climatology.climatology(a.daily(spark, d), a.WEATHER)


@query(
    "D04_climatology_defined_sd",
    "SELECT ix, iy, doy, temperature, temperature_sd FROM clim WHERE temperature_sd IS NOT NULL",
    "temperature temperature_sd",
)
def _(spark, d):
    return climatology.climatology(a.daily(spark, d), ["temperature"], require_sd=True)


@query("D05_anomalies", "SELECT * FROM anoms", " ".join(ANOM))
def _(spark, d):
    daily = a.daily(spark, d)
    return climatology.anomalies(daily, climatology.climatology(daily, a.WEATHER), a.WEATHER)


@query("D05_own_anomalies", "SELECT * FROM anoms", " ".join(ANOM))
def _(spark, d):
    return climatology.own_anomalies(a.daily(spark, d), a.WEATHER)


@query(
    "D05_anomalies_keep_null",
    """SELECT d.ix, d.iy, d.date, CAST(dayofyear(d.date) AS INT) AS doy, CAST(month(d.date) AS INT) AS month, CAST(year(d.date) AS INT) AS year,
      d.relative_humidity - k.relative_humidity AS anomaly_relative_humidity,
      CASE WHEN abs(k.relative_humidity_sd) > 1e-12 * abs(k.relative_humidity) THEN (d.relative_humidity - k.relative_humidity) / k.relative_humidity_sd END AS anomaly_scaled_relative_humidity
    FROM daily d LEFT JOIN (SELECT * FROM clim WHERE relative_humidity_sd IS NOT NULL) k ON k.ix = d.ix AND k.iy = d.iy AND k.doy = dayofyear(d.date)""",
    "anomaly_relative_humidity anomaly_scaled_relative_humidity",
)
def _(spark, d):
    daily = a.daily(spark, d)
    clim = climatology.climatology(daily, ["relative_humidity"], require_sd=True)
    return climatology.anomalies(daily, clim, ["relative_humidity"], drop_null=False)


@query("D06_forecast_anomalies", "SELECT * FROM forecast_anoms", " ".join(FANOM))
def _(spark, d):
    fc = forecast.normalize_forecast(a.forecast_members(spark, d))
    clim = climatology.climatology(a.daily(spark, d), a.WEATHER)
    return forecast.forecast_anomalies(fc, clim, a.model_days(spark, d), a.BREAKS)


@query("D07_normalize_forecast", "SELECT ix, iy, base_date, month, year, lead_month, lead_year, " + ", ".join(STATS) + " FROM forecast", " ".join(STATS))
def _(spark, d):
    return forecast.normalize_forecast(a.forecast_members(spark, d))


VALID = [f"anomaly_{c}{s}_{k}" for c in a.WEATHER for s in ("", "_scaled") for k in ("forecast", "recorded", "difference")]
cte(
    "recorded",
    "SELECT coalesce(r.ix, h.ix) AS ix, coalesce(r.iy, h.iy) AS iy, coalesce(r.date, h.date) AS date, coalesce(r.hi, h.hi) AS hi, "
    + ", ".join(f"r_{c} - h_{c} AS rec_{c}, CASE WHEN abs(s_{c}) > 1e-12 * abs(h_{c}) THEN (r_{c} - h_{c}) / s_{c} END AS recs_{c}" for c in a.WEATHER)
    + " FROM (SELECT w.ix, w.iy, s.date, s.hi, "
    + ", ".join(f"CASE WHEN count(w.{c}) = count(*) THEN avg(w.{c}) END AS r_{c}" for c in a.WEATHER)
    + " FROM span_days s JOIN daily w ON w.date = s.day GROUP BY 1, 2, 3, 4) r FULL JOIN (SELECT k.ix, k.iy, s.date, s.hi, "
    + ", ".join(f"avg(k.{c}) AS h_{c}, avg(k.{c}_sd) AS s_{c}" for c in a.WEATHER)
    + " FROM span_days s JOIN clim k ON k.doy = dayofyear(s.day) GROUP BY 1, 2, 3, 4) h ON r.ix = h.ix AND r.iy = h.iy AND r.date = h.date AND r.hi = h.hi",
)
cte(
    "validated",
    "SELECT f.ix, f.iy, f.date, f.forecast_interval, "
    + ", ".join(
        f"f.anomaly_forecast_{s}{c} AS anomaly_{c}{t}_forecast, r.{p}_{c} AS anomaly_{c}{t}_recorded, f.anomaly_forecast_{s}{c} - r.{p}_{c} AS anomaly_{c}{t}_difference"
        for c in a.WEATHER
        for s, t, p in (("", "", "rec"), ("scaled_", "_scaled", "recs"))
    )
    + " FROM forecast_anoms f LEFT JOIN recorded r ON r.ix = f.ix AND r.iy = f.iy AND r.date = f.date AND r.hi = f.forecast_interval",
)


def validated_wide(spark, d):
    """Of anomalies that are there already, one row per cell and date."""
    daily, dates = a.daily(spark, d), a.model_days(spark, d)
    clim = climatology.climatology(daily, a.WEATHER)
    fc = forecast.normalize_forecast(a.forecast_members(spark, d))
    anom = forecast.forecast_anomalies(fc, clim, dates, a.BREAKS)
    return forecast.validate_forecast(anom, daily, clim, dates, a.BREAKS, wide=True)


@query("D08_validate_forecast", "SELECT * FROM validated", " ".join(VALID))
def _(spark, d):
    daily = a.daily(spark, d)
    fc = forecast.normalize_forecast(a.forecast_members(spark, d))
    return forecast.forecast_and_recorded(fc, daily, climatology.climatology(daily, a.WEATHER), a.model_days(spark, d), a.BREAKS)


@query(
    "D08_validate_forecast_wide",
    "SELECT ix, iy, date, "
    + ", ".join(f"max(CASE WHEN forecast_interval = {e} THEN {v} END) AS {v}_{e - 1}" for e in a.BREAKS[1:] for v in VALID)
    + " FROM validated GROUP BY ix, iy, date",
    " ".join(f"{v}_{e - 1}" for e in a.BREAKS[1:] for v in VALID),
)
def _(spark, d):
    return validated_wide(spark, d)


LAGS = ("temperature", "relative_humidity")


@query(
    "D09_interval_lags",
    "SELECT d.*, "
    + ", ".join(
        f"(SELECT avg(p.{c}) FROM daily p WHERE p.ix = d.ix AND p.iy = d.iy AND p.date BETWEEN d.date - {i * 30} AND d.date - {(i - 1) * 30 + 1}) AS {c}_lag_{i * 30}"
        for c in LAGS
        for i in (1, 2, 3)
    )
    + " FROM daily d",
    " ".join([*a.WEATHER, *[f"{c}_lag_{n}" for c in LAGS for n in (30, 60, 90)]]),
)
def _(spark, d):
    return interval_lags(a.daily(spark, d), LAGS, one_row_per_day=True)


def sampled(spark, d):
    """Anomalies on sampled days only: two days of most months, with a gap of several months in every year."""
    day, month = F.dayofmonth("date"), F.month("date")
    anoms = climatology.own_anomalies(a.daily(spark, d), a.WEATHER, drop_null=False)
    return anoms.where(day.isin(5, 20) & ~month.isin(5, 6, 7, 8))


cte(
    "sampled",
    """SELECT d.ix, d.iy, d.date, """
    + ", ".join(
        f"CASE WHEN k.{c}_sd IS NULL THEN NULL ELSE 0 END AS z_{c}, d.{c} - k.{c} AS anomaly_{c}, CASE WHEN abs(k.{c}_sd) > 1e-12 * abs(k.{c}) THEN (d.{c} - k.{c}) / k.{c}_sd END AS anomaly_scaled_{c}"
        for c in a.WEATHER
    )
    + """ FROM daily d JOIN clim k ON k.ix = d.ix AND k.iy = d.iy AND k.doy = dayofyear(d.date)
    WHERE day(d.date) IN (5, 20) AND month(d.date) NOT IN (5, 6, 7, 8)""",
)
cte(
    "lag_plan",
    """SELECT m.date, b.far, b.near, count(s.date) AS n, max(e.date) AS fallback
    FROM (SELECT DISTINCT date FROM sampled) m CROSS JOIN (VALUES (30, 1), (60, 31), (90, 61)) AS b(far, near)
      LEFT JOIN (SELECT DISTINCT date FROM sampled) s ON s.date BETWEEN m.date - b.far AND m.date - b.near
      LEFT JOIN (SELECT DISTINCT date FROM sampled) e ON e.date < m.date - b.near
    GROUP BY ALL""",
)
LAGGED = tuple(f"anomaly_{s}{c}" for s in ("", "scaled_") for c in a.WEATHER)
cte(
    "lag_means",
    "SELECT r.ix, r.iy, r.date, "
    + ", ".join(
        f"max(CASE WHEN g.far = {f} THEN g.{c} END) AS {c}_{f}" for c in LAGGED for f in (30, 60, 90)
    )
    + """ FROM sampled r LEFT JOIN (SELECT l.ix, l.iy, p.date, p.far, """
    + ", ".join(f"CASE WHEN count(l.{c}) = count(*) THEN avg(l.{c}) END AS {c}" for c in LAGGED)
    + """ FROM lag_plan p JOIN sampled l ON CASE WHEN p.n > 0 THEN l.date BETWEEN p.date - p.far AND p.date - p.near ELSE l.date = p.fallback END
      GROUP BY 1, 2, 3, 4) g ON g.ix = r.ix AND g.iy = r.iy AND g.date = r.date
    WHERE r.date NOT IN (SELECT date FROM lag_plan WHERE fallback IS NULL)
    GROUP BY 1, 2, 3""",
)


@query("D10_lag_means_by_available_dates", "SELECT * FROM lag_means", " ".join(f"{c}_{f}" for c in LAGGED for f in (30, 60, 90)))
def _(spark, d):
    return districts.lag_means_by_available_dates(sampled(spark, d), LAGGED)


def soil(spark, d):
    return layers.soil_classes(a.layers(spark, d), a.soil_key(spark, d))


def livestock(spark, d):
    """Two frames of one source with different columns."""
    l = a.layers(spark, d)
    return [l.select("ix", "iy", F.col("economy").alias("glw_cattle")), l.select("ix", "iy", F.col("small").alias("glw_sheep"))]


@query(
    "D11_assemble_predictors",
    """SELECT DISTINCT * FROM (SELECT * FROM anoms WHERE date IN (SELECT date FROM model_days)) NATURAL JOIN soil
      NATURAL JOIN (SELECT ix, iy, economy AS glw_cattle FROM layers) NATURAL JOIN (SELECT ix, iy, small AS glw_sheep FROM layers)
    WHERE glw_cattle IS NOT NULL AND glw_sheep IS NOT NULL AND """
    + " AND ".join(f"{c} IS NOT NULL" for c in ANOM),
    " ".join(ANOM),
)
def _(spark, d):
    anoms = climatology.own_anomalies(a.daily(spark, d), a.WEATHER)
    return assemble.assemble_predictors(
        {"weather_anomalies": anoms, "soil": soil(spark, d), "livestock": livestock(spark, d)}, a.model_days(spark, d)
    )


@query("D12_outbreak_response", "SELECT * FROM response", "cases")
def _(spark, d):
    return events.outbreak_response(a.outbreaks(spark, d), a.grid_spec(spark, d), a.model_days(spark, d), a.RESPONSE_BREAKS)


cte("ob_points", "SELECT DISTINCT longitude, latitude, start_date FROM outbreaks")
cte("ob_places", "SELECT DISTINCT longitude, latitude FROM outbreaks")
cte("ob_within", a.inside_sql("ob_places", "longitude latitude", "longitude", "latitude", boundary=False))


@query(
    "D13_outbreak_flag",
    """SELECT DISTINCT m.date, w.region, TRUE AS outbreak_30 FROM ob_points o JOIN ob_within w USING (longitude, latitude)
      JOIN model_days m ON o.start_date - m.date BETWEEN 1 AND 30""",
)
def _(spark, d):
    return events.outbreak_flag(a.outbreaks(spark, d), a.regions(spark, d), a.model_days(spark, d))


@query(
    "D14_mask_to_regions",
    "SELECT d.*, r.region FROM daily d JOIN cell_region r USING (ix, iy)",
    " ".join(a.WEATHER),
)
def _(spark, d):
    return mask_to_regions(a.daily(spark, d), a.regions(spark, d), a.grid_spec(spark, d))


def masked_predictors(spark, d):
    """Sampled predictors with soil classes and two forecast intervals, masked to regions."""
    rows = sampled(spark, d).join(soil(spark, d).withColumn("soil_texture", F.nullif("soil_texture", F.lit("UNK"))), ["ix", "iy"])
    rows = rows.withColumns({"slope": F.lit("1"), "aspect": F.lit("2"), "soil_texture": F.coalesce("soil_texture", F.lit("UNK"))})
    rows = rows.withColumn("forecast_interval", F.explode(F.array(F.lit(30), F.lit(60))))
    rows = rows.withColumn("anomaly_forecast_temperature", F.col("anomaly_temperature") * F.col("forecast_interval"))
    return mask_to_regions(rows, a.regions(spark, d), a.grid_spec(spark, d))


def _nearest_sql(column: str, known: str) -> str:
    return f"""SELECT h.ix, h.iy, arg_min(k.{column}, (h.ix - k.ix) * (h.ix - k.ix) * 1000000000000 + (h.iy - k.iy) * (h.iy - k.iy) * 1000000000000 + k.ix * 1000 + k.iy) AS {column}
    FROM (SELECT ix, iy FROM {known} WHERE {column} = 'UNK') h, (SELECT * FROM {known} WHERE {column} <> 'UNK') k GROUP BY 1, 2"""


cte("masked_soil", "SELECT * FROM soil WHERE (ix, iy) IN (SELECT (s.ix, s.iy) FROM sampled s JOIN cell_region USING (ix, iy))")
cte("near_drainage", _nearest_sql("soil_drainage", "masked_soil"))
cte("near_texture", _nearest_sql("soil_texture", "masked_soil"))
cte(
    "district_cells",
    """SELECT r.region, s.ix, s.iy, s.date, fi.hi AS forecast_interval,
      CAST(CASE coalesce(nd.soil_drainage, so.soil_drainage) WHEN 'E' THEN 1 WHEN 'SE' THEN 2 WHEN 'W' THEN 3 WHEN 'MW' THEN 4 WHEN 'I' THEN 5 WHEN 'P' THEN 6 WHEN 'VP' THEN 7 END AS DOUBLE) AS soil_drainage,
      CAST(coalesce(nt.soil_texture, so.soil_texture) AS DOUBLE) AS soil_texture,
      s.anomaly_temperature * fi.hi AS anomaly_forecast_temperature
    FROM sampled s JOIN cell_region r USING (ix, iy) JOIN soil so USING (ix, iy)
      LEFT JOIN near_drainage nd USING (ix, iy) LEFT JOIN near_texture nt USING (ix, iy),
      (VALUES (30), (60)) AS fi(hi)""",
)
DIST = ["cases", "soil_drainage", "soil_texture", "anomaly_forecast_temperature", *[f"{c}_{f}" for c in LAGGED for f in (30, 60, 90)]]


@query(
    "D15_district_features",
    "SELECT *, CASE WHEN cases > 0 THEN 1 ELSE 0 END AS outbreak FROM (SELECT region, date, forecast_interval, "
    + ", ".join(f"CASE WHEN count({c}) = count(*) THEN avg({c}) END AS {c}" for c in DIST)
    + """ FROM (SELECT c.*, coalesce(e.cases, 0) AS cases, """
    + ", ".join(f"l.{c}_{f}" for c in LAGGED for f in (30, 60, 90))
    + """ FROM district_cells c JOIN lag_means l ON l.ix = c.ix AND l.iy = c.iy AND l.date = c.date
        LEFT JOIN (SELECT o.ix, o.iy, m.date, b.hi AS forecast_interval, sum(coalesce(o.cases, 0)) AS cases
          FROM outbreaks o JOIN (SELECT DISTINCT date FROM sampled) m ON TRUE JOIN (VALUES (1, 30), (30, 60)) AS b(lo, hi)
            ON o.start_date >= m.date + b.lo AND o.start_date < m.date + b.hi GROUP BY ALL) e
          ON e.ix = c.ix AND e.iy = c.iy AND e.date = c.date AND e.forecast_interval = c.forecast_interval)
    GROUP BY 1, 2, 3)""",
    " ".join(DIST),
)
def _(spark, d):
    rows = cut(masked_predictors(spark, d))  # a stored table in a real run: it is read several times
    response = events.outbreak_response(a.outbreaks(spark, d), a.grid_spec(spark, d), rows, (1, 30, 60))
    return districts.district_features(rows, response)


cte(
    "inner_cell_region",
    """SELECT r.* FROM cell_region r, (SELECT min(least(x1, x2)) AS xmin, max(greatest(x1, x2)) AS xmax, min(least(y1, y2)) AS ymin, max(greatest(y1, y2)) AS ymax FROM edges) b
    WHERE r.x > b.xmin AND r.x < b.xmax AND r.y > b.ymin AND r.y < b.ymax""",
)
SPEC = {"x": None, "y": None, "year": None, "temperature": "AVG", "precipitation": "SUM", "month": "MODE"}


@query(
    "D16_aggregate_by_region",
    """SELECT g.region, g.year, g.temperature_avg, g.precipitation_sum, m.month_mode, ar.area FROM (
      SELECT r.region, CAST(year(d.date) AS INT) AS year, avg(d.temperature) AS temperature_avg, sum(d.precipitation) AS precipitation_sum
      FROM daily d JOIN inner_cell_region r USING (ix, iy) GROUP BY 1, 2) g
    JOIN (SELECT region, year, CAST(month AS INT) AS month_mode FROM (
      SELECT *, row_number() OVER (PARTITION BY region, year ORDER BY n DESC, month) AS rn FROM (
        SELECT r.region, CAST(year(d.date) AS INT) AS year, month(d.date) AS month, count(*) AS n FROM daily d JOIN inner_cell_region r USING (ix, iy) GROUP BY 1, 2, 3)) WHERE rn = 1) m
      ON m.region = g.region AND m.year = g.year
    JOIN (SELECT region, abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 63710088e-4 * 63710088e-4 / 2 AS area FROM edges GROUP BY 1) ar ON ar.region = g.region""",
    "temperature_avg precipitation_sum area",
)
def _(spark, d):
    daily = a.daily(spark, d).withColumns({"year": F.year("date"), "month": F.month("date")})
    return aggregate_by_region(daily, a.regions(spark, d), a.grid_spec(spark, d), SPEC)


_KM = "2 * 63710088e-4 * asin(least(1, sqrt(pow(sin(radians(g.y - o.latitude) / 2), 2) + cos(radians(o.latitude)) * cos(radians(g.y)) * pow(sin(radians(g.x - o.longitude) / 2), 2))))"
cte("near_events", f"SELECT g.ix, g.iy, o.outbreak_id, o.cases, o.start_date, {_KM} AS km FROM grid g, outbreaks o WHERE {_KM} <= 500")
cte(
    "history",
    """SELECT g.ix, g.iy, m.date, CAST(dayofyear(m.date) AS INT) AS doy, CAST(month(m.date) AS INT) AS month, CAST(year(m.date) AS INT) AS year,
      coalesce(h.r, 0) AS outbreak_history_weight_recent, coalesce(h.o, 0) AS outbreak_history_weight_old
    FROM grid g CROSS JOIN model_days m LEFT JOIN (
      SELECT ix, iy, date, sum(CASE WHEN yrs < 25e-2 THEN w ELSE 0 END) AS r, sum(CASE WHEN yrs >= 25e-2 THEN w ELSE 0 END) AS o
      FROM (SELECT e.ix, e.iy, m.date, (m.date - e.start_date) / 36525e-2 AS yrs,
          CASE WHEN cases IS NULL THEN 1 ELSE log10(cases + 1) END * exp(-5e-1 * ((m.date - e.start_date) / 36525e-2)) * exp(-1e-2 * km) AS w
        FROM near_events e JOIN model_days m ON m.date > e.start_date AND (m.date - e.start_date) / 36525e-2 < 10)
      GROUP BY 1, 2, 3) h ON h.ix = g.ix AND h.iy = g.iy AND h.date = m.date""",
)


def history(spark, d):
    return events.outbreak_history(a.model_days(spark, d), a.outbreaks(spark, d), a.grid_spec(spark, d))


@query("D17_outbreak_history", "SELECT * FROM history", "outbreak_history_weight_recent outbreak_history_weight_old")
def _(spark, d):
    return history(spark, d)


@query(
    "D18_history_metadata",
    """SELECT DISTINCT year, (SELECT min(least(outbreak_history_weight_recent, outbreak_history_weight_old)) FROM history) AS min,
      (SELECT max(greatest(outbreak_history_weight_recent, outbreak_history_weight_old)) FROM history) AS max FROM history""",
    "min max",
)
def _(spark, d):
    return events.history_metadata(history(spark, d))


def outbreaks_raw(spark, d):
    """Orders as raw reports: the priority stands for the disease, nation numbers for country codes."""
    o = a.table(spark, d, "orders")
    c = a.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    day = F.to_date("o_orderdate")
    return o.join(c, "o_custkey").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "Rift Valley Fever").otherwise("other").alias("standardized_disease_name"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("country_unique_code"),
        F.when(F.col("o_orderkey") % 5 != 0, day).alias("outbreak_start_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_add(day, F.expr("cast(o_orderkey % 3 as int)"))).alias("outbreak_end_date"),
        F.expr("-10D + 0.5D * (o_custkey % 5)").alias("latitude"),
        F.expr("20D + 0.5D * (o_custkey div 150)").alias("longitude"),
        (F.col("o_custkey") % 7).alias("cases"),
    )


def country_codes(spark, d):
    n = a.table(spark, d, "nation")
    r = a.table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso_code"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("continent"),
    )


@query(
    "D19_clean_outbreaks",
    """SELECT cases, start_date, end_date, latitude, longitude,
      CAST(row_number() OVER (ORDER BY end_date NULLS FIRST, latitude, longitude, cases, start_date) AS INT) AS outbreak_id
    FROM (SELECT DISTINCT CAST(o_custkey % 7 AS INT) AS cases, coalesce(s, e) AS start_date, coalesce(e, s) AS end_date,
        -10 + 5e-1 * (o_custkey % 5) AS latitude, 20 + 5e-1 * (o_custkey // 150) AS longitude
      FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS s,
          CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) END AS e FROM orders WHERE o_orderpriority = '1-URGENT')
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
      WHERE r_name = 'AFRICA')""",
    "latitude longitude",
)
def _(spark, d):
    return events.clean_outbreaks(outbreaks_raw(spark, d), country_codes(spark, d))


@query(
    "D19_clean_controls",
    """SELECT lower(n_name) AS country, 'n' || n_nationkey AS country_unique_code, 'N' || n_nationkey AS iso_code, r_name AS continent, CAST(count(*) AS BIGINT) AS n
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE o_orderpriority = '1-URGENT' AND r_name = 'AFRICA' GROUP BY ALL""",
)
def _(spark, d):
    codes = country_codes(spark, d)
    raw = outbreaks_raw(spark, d).join(codes.select(F.lower("iso_code").alias("country_unique_code"), "country"), "country_unique_code")
    out = events.clean_controls(raw, codes)
    return out.groupBy("country", "country_unique_code", "iso_code", "continent").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D20_clean_weather",
    """SELECT 20 + 5e-1 * ix AS x, -10 + 5e-1 * iy AS y, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
      CAST(dayofyear(date) AS INT) AS doy, relative_humidity, temperature, precipitation, date FROM daily""",
    "x y " + " ".join(a.WEATHER),
)
def _(spark, d):
    raw = a.daily(spark, d).select(
        F.expr("20D + 0.5D * ix").alias("LON"),
        F.expr("-10D + 0.5D * iy").alias("LAT"),
        F.year("date").cast("double").alias("YEAR"),
        F.month("date").cast("double").alias("MM"),
        F.dayofmonth("date").cast("double").alias("DD"),
        F.dayofyear("date").alias("DOY"),
        F.col("date").alias("YYYYMMDD"),
        F.col("relative_humidity").alias("RH2M"),
        F.col("temperature").alias("T2M"),
        F.col("precipitation").alias("PRECTOTCORR"),
    )
    return layers.clean_weather(raw)


@query("D21_soil_classes", "SELECT ix, iy, soil_drainage, soil_texture FROM soil")
def _(spark, d):
    return soil(spark, d)


BANDS = [t.lower() for t in a.TYPES]
cte(
    "top_band",
    "SELECT ix, iy, list_position(b, list_max(b)) AS aspect FROM (SELECT ix, iy, [" + ", ".join(BANDS) + "] AS b FROM layers)",
)


@query(
    "D22_dominant_class",
    """SELECT ix, iy, CAST(aspect AS VARCHAR) AS aspect FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY n DESC, aspect) AS rn
      FROM (SELECT CAST(ix // 2 AS INT) AS ix, CAST(iy // 2 AS INT) AS iy, aspect, count(*) AS n FROM top_band WHERE aspect IS NOT NULL GROUP BY ALL)) WHERE rn = 1""",
)
def _(spark, d):
    spec = a.grid_spec(spark, d)
    return layers.dominant_class(a.layers(spark, d), BANDS, "aspect", a.fine_spec(spec), spec)


@query(
    "D23_static_layers",
    """SELECT l.ix, l.iy, l."wc2.1_30s_elev" AS elevation, l.price AS bio_price, f.* EXCLUDE (ix, iy) FROM layers l LEFT JOIN (
      SELECT ix, iy, trees, grassland, bare FROM (
        SELECT ix, iy, economy / 40e0 AS trees, small / 40e0 AS grassland, large / 40e0 AS bare FROM layers)
      WHERE trees IS NOT NULL AND grassland IS NOT NULL AND bare IS NOT NULL
      UNION ALL
      SELECT ix, iy, coalesce(economy / 40e0, 0), coalesce(small / 40e0, 0), 1 - (coalesce(economy / 40e0, 0) + coalesce(small / 40e0, 0)) FROM layers WHERE large IS NULL) f
      ON f.ix = l.ix AND f.iy = l.iy""",
    "elevation bio_price trees grassland bare",
)
def _(spark, d):
    raw = a.layers(spark, d)
    plain = layers.static_layer(raw, {"wc2.1_30s_elev": "elevation", "price": "bio_price"})
    cover = raw.select("ix", "iy", *[(F.col(c) / 40.0).alias(n) for c, n in (("economy", "trees"), ("small", "grassland"), ("large", "bare"))])
    return plain.join(layers.fill_landcover(cover, ["trees", "grassland", "bare"]), ["ix", "iy"], "left")


SUMMARY = [f"{c}_{s}" for c in a.WEATHER for s in ("mean", "sd", "min", "max", "range")]


@query(
    "D24_yearly_summary",
    "SELECT ix, iy, "
    + ", ".join(
        f"CASE WHEN count({c}_{s}) = count(*) THEN avg({c}_{s}) END AS {c}_{s}" for c in a.WEATHER for s in ("mean", "sd", "min", "max", "range")
    )
    + " FROM (SELECT ix, iy, year(date) AS yr, "
    + ", ".join(
        f"CASE WHEN count({c}) = count(*) THEN {e} END AS {c}_{s}"
        for c in a.WEATHER
        for s, e in (("mean", f"avg({c})"), ("sd", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"), ("range", f"max({c}) - min({c})"))
    )
    + " FROM daily GROUP BY 1, 2, 3) GROUP BY 1, 2",
    " ".join(SUMMARY),
)
def _(spark, d):
    return climatology.combined_summary(a.daily(spark, d), a.WEATHER)


@query(
    "D24_impute_summary",
    """SELECT h.ix, h.iy, coalesce(h.v, (SELECT k.v FROM layers_v k WHERE k.v IS NOT NULL
      ORDER BY (h.ix - k.ix) * (h.ix - k.ix) + (h.iy - k.iy) * (h.iy - k.iy), k.ix, k.iy LIMIT 1)) AS v FROM layers_v h""",
    "v",
)
def _(spark, d):
    from ..operators.nearest import fill_nearest

    v = F.when(F.col("unit") < 48, F.col("price")).alias("v")
    return fill_nearest(a.layers(spark, d).select("ix", "iy", v), ["v"])


cte("layers_v", "SELECT ix, iy, CASE WHEN unit < 48 THEN price END AS v FROM layers")


@query(
    "D25_outbreak_spread",
    """SELECT o_custkey AS epi_event_id, outbreak_start_date, longitude, latitude, outbreak_start_date - first_day AS days,
      outbreak_start_date = first_day AS origin_loc, CASE WHEN n = 1 THEN 'Single Outbreak' ELSE 'Outbreak Origin' END AS single_outbreak,
      strftime(first_day, '%Y-%m-%d') AS label
    FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS outbreak_start_date, 5e-1 * (o_custkey // 150) AS longitude, 5e-1 * nullif(o_custkey % 5, 0) AS latitude,
        min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS first_day, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    WHERE latitude IS NOT NULL""",
    "longitude latitude",
)
def _(spark, d):
    points = a.table(spark, d, "orders").select(
        F.col("o_custkey").alias("epi_event_id"),
        F.to_date("o_orderdate").alias("outbreak_start_date"),
        F.expr("cast(0.5D * (o_custkey div 150) as string)").alias("longitude"),
        F.expr("cast(0.5D * nullif(o_custkey % 5, 0) as string)").alias("latitude"),
    )
    return events.outbreak_spread(points)


@query(
    "D26_model_dates",
    """SELECT date, orders FROM (SELECT date, row_number() OVER (PARTITION BY year(date), month(date) ORDER BY md5(strftime(date, '%Y-%m-%d') || ':212'), date) AS r
      FROM (SELECT CAST(u.day AS DATE) AS date FROM unnest(generate_series((SELECT date_trunc('year', min(o_orderdate)) FROM orders),
        (SELECT date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM orders), INTERVAL 1 DAY)) AS u(day)))
    LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1) USING (date) WHERE r <= 2""",
)
def _(spark, d):
    """Two sampled days per month over the years of the orders, joined to what was ordered on them."""
    o = a.table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    years = o.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    days = calendars.model_dates(spark, years[0], years[1], n_per_month=2, seed=212)
    counts = o.groupBy("date").agg(F.count(F.lit(1)).alias("orders"))
    return days.join(counts, "date", "left")


@query(
    "D26_model_dates_all_days",
    """SELECT CAST(u.day AS DATE) AS date FROM unnest(generate_series(
      (SELECT date_trunc('year', min(o_orderdate)) FROM orders), (SELECT date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM orders), INTERVAL 1 DAY)) AS u(day)""",
)
def _(spark, d):
    years = a.table(spark, d, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return calendars.model_dates(spark, years[0], years[1])


@query(
    "D27_join_layers",
    """SELECT d.ix, d.iy, d.date, d.temperature, k.temperature_sd AS temperature_scaled, s.soil_drainage, s.soil_texture
    FROM daily d LEFT JOIN (SELECT d2.ix, d2.iy, d2.date, k.temperature_sd FROM daily d2 JOIN clim k ON k.ix = d2.ix AND k.iy = d2.iy AND k.doy = dayofyear(d2.date)) k
      ON k.ix = d.ix AND k.iy = d.iy AND k.date = d.date
    LEFT JOIN soil_target s ON s.ix = d.ix AND s.iy = d.iy""",
    "temperature temperature_scaled",
)
def _(spark, d):
    daily = a.daily(spark, d).select("ix", "iy", "date", "temperature")
    clim = climatology.climatology(daily, ["temperature"])
    scaled = daily.withColumn("doy", F.dayofyear("date")).join(clim.select("ix", "iy", "doy", F.col("temperature_sd").alias("temperature_scaled")), ["ix", "iy", "doy"])
    target = a.grid_spec(spark, d)
    static = layers.soil_classes(a.layers(spark, d), a.soil_key(spark, d), a.fine_spec(target), target)
    return assemble.join_layers([static], [daily, scaled.drop("doy", "temperature")])


cte("soil_target", "SELECT CAST((ix - 1) // 2 AS INT) AS ix, CAST((iy - 1) // 2 AS INT) AS iy, soil_drainage, soil_texture FROM soil WHERE ix % 2 = 1 AND iy % 2 = 1")


@query(
    "D28_attach_response",
    """SELECT d.ix, d.iy, coalesce(r.cases, 0) AS cases, d.date, b.hi AS forecast_interval, d.temperature
    FROM daily d CROSS JOIN (VALUES (30), (90)) AS b(hi) LEFT JOIN response r ON r.ix = d.ix AND r.iy = d.iy AND r.date = d.date AND r.forecast_interval = b.hi""",
    "cases temperature",
)
def _(spark, d):
    preds = a.daily(spark, d).select("ix", "iy", "date", "temperature").withColumn("forecast_interval", F.explode(F.array(F.lit(30), F.lit(90))))
    response = events.outbreak_response(a.outbreaks(spark, d), a.grid_spec(spark, d), a.model_days(spark, d), a.RESPONSE_BREAKS)
    return assemble.attach_response(preds, response)
