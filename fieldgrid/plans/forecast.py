"""Seasonal forecasts: ensemble statistics, interval anomalies and their validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import CELL
from ..functions.climate import KELVIN_OFFSET, rate_to_mm_per_day, relative_humidity, relative_humidity_sd
from ..functions.columns import ratio
from ..functions.dates import interval_table, whole_months, with_date_parts
from ..operators.grid import with_dates
from ..operators.joins import latest_at_or_before
from ..session import calendar_side
from .cells import Calendar, interval_means, packed, range_sums

WEATHER = ("temperature", "precipitation", "relative_humidity")


def _by_issue(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members placed by cell and issue date, the only shuffle of the statistics grouped below that.

    A group has few members, so adding them up before the shuffle would move a wide state for nearly every member.
    Leads and variables of an issue travel side by side instead, which compresses well.
    """
    return members.repartition(*keys, "base_date")


def ensemble_stats(members: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean and sample deviation over the ensemble members of each cell, issue date, lead and variable."""
    rows = _by_issue(members, keys)
    if "lead_months" not in rows.columns:
        rows = rows.withColumn("lead_months", whole_months(F.col("base_date"), F.col("forecast_end_date")))
    group = [*keys, "base_date", "lead_months", "forecast_end_date", "variable", "units"]
    return rows.groupBy(*group).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def normalize_forecast(members: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Ensemble members to one row per cell, issue date and lead month with Celsius, mm/day and humidity.

    ``units == "C"`` marks temperatures (labelled Celsius, delivered in Kelvin); an empty unit marks the
    precipitation rate.  The lead month is the month of the day before ``forecast_end_date``.

    Ensemble statistics and the spread to one column per variable are the same aggregate, conditional on the
    variable: there is one shuffle and no pivot pass follows.
    """
    names = ("temperature", "dewpoint", "precipitation")
    aggregates = []
    for v in names:
        here = F.when(F.col("variable") == v, F.col("value"))
        aggregates += [
            F.avg(here).alias(f"_m_{v}"),
            F.stddev_samp(here).alias(f"_s_{v}"),
            # Flags, not the unit itself: a text among the aggregates would have every row sorted.
            F.max(F.when(F.col("variable") == v, (F.col("units") == "C").cast("int"))).alias(f"_c_{v}"),
            F.min(F.when(F.col("variable") == v, (F.col("units") == "").cast("int"))).alias(f"_e_{v}"),
        ]
    used = members.select(*keys, "base_date", "forecast_end_date", "variable", "units", "value")
    stats = _by_issue(used, keys).groupBy(*keys, "base_date", "forecast_end_date").agg(*aggregates)

    def mean_of(v: str):
        m = F.col(f"_m_{v}")
        return F.when(F.col(f"_c_{v}") == 1, m - F.lit(KELVIN_OFFSET)).otherwise(rate_to_mm_per_day(m))

    def sd_of(v: str):
        sd = F.col(f"_s_{v}")
        return F.when(F.col(f"_e_{v}") == 1, rate_to_mm_per_day(sd)).otherwise(sd)

    t, d = mean_of("temperature"), mean_of("dewpoint")
    last_day = F.date_sub("forecast_end_date", 1)
    return stats.select(
        *keys,
        "base_date",
        F.month("base_date").alias("month"),
        F.year("base_date").alias("year"),
        F.month(last_day).alias("lead_month"),
        F.year(last_day).alias("lead_year"),
        t.alias("temperature"),
        mean_of("precipitation").alias("precipitation"),
        relative_humidity(t, d).alias("relative_humidity"),
        sd_of("temperature").alias("temperature_sd"),
        sd_of("precipitation").alias("precipitation_sd"),
        relative_humidity_sd(t, sd_of("temperature"), d, sd_of("dewpoint")).alias("relative_humidity_sd"),
    )


def interval_segments(dates: DataFrame, breaks: Sequence[int]) -> DataFrame:
    """Model dates x forecast intervals cut at month ends.

    ``date, lo, hi, year, month, first_doy, last_doy``: within one month the days of year are consecutive, so a
    segment is known by its two ends.  A calendar table: dates x intervals x about two months.
    """
    spans = with_dates(interval_table(dates.sparkSession, breaks), dates)
    spans = spans.withColumns({"_a": F.date_add("date", F.col("lo")), "_b": F.date_add("date", F.col("hi") - 1)})
    months = spans.withColumn("_m", F.explode(F.expr("sequence(trunc(_a, 'MM'), _b, interval 1 month)")))
    months = months.withColumns({"_f": F.greatest("_a", "_m"), "_l": F.least("_b", F.last_day("_m"))})
    return months.select(
        "date",
        "lo",
        "hi",
        F.year("_m").alias("year"),
        F.month("_m").alias("month"),
        F.dayofyear("_f").alias("first_doy"),
        F.dayofyear("_l").alias("last_doy"),
    )


def _segment_sums(clim: DataFrame, segments: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sums and counts of the daily climatology over each distinct segment, per cell."""
    distinct = segments.select("first_doy", "last_doy").distinct()
    sums = {f"_s_{c}": F.col(c) for c in columns} | {f"_n_{c}": F.col(c).isNotNull().cast("long") for c in columns}
    return range_sums(clim, "doy", sums | {"_days": F.lit(1)}, distinct, "first_doy", "last_doy", keys).where("_days > 0")


def _climate_part(clim: DataFrame, value_cols: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Of the climatology (one row a cell and day of year) what intervals need."""
    both = [*value_cols, *[f"{c}_sd" for c in value_cols]]
    known = clim.where(F.col("doy").between(1, 366))
    return known, {"at": F.col("doy").cast("int"), **{c: F.col(c).cast("double") for c in both}}


def _lead_part(forecast: DataFrame, value_cols: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Of the forecast (one row a cell, issue and month ahead)."""
    dates = {"base": F.unix_date("base_date"), "year": F.col("lead_year").cast("int"), "month": F.col("lead_month").cast("int")}
    known = forecast.where(F.col("base_date").isNotNull() & F.col("lead_year").isNotNull() & F.col("lead_month").isNotNull())
    return known, {**dates, **{c: F.col(c).cast("double") for c in value_cols}}


def _seen_part(daily: DataFrame, value_cols: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Days of a cell, added up to one entry each."""
    measures = [F.count(F.lit(1)).cast("double").alias("rows")]
    measures += [F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in value_cols] + [F.count(c).cast("double").alias(f"n_{c}") for c in value_cols]
    days = daily.where(F.col("date").isNotNull()).groupBy(*keys, "date").agg(*measures)
    return days, {"at": F.unix_date("date"), "rows": F.col("rows"), **{f"{k}_{c}": F.col(f"{k}_{c}") for c in value_cols for k in "sn"}}


def _recorded_days(calendar: Calendar, breaks: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """First day and length of each group of the calendar."""
    low = dict(zip(breaks[1:], breaks[:-1]))
    size = np.array([h - low[h] for h in calendar.hi.tolist()], np.int64)
    return calendar.date + calendar.hi - size, size


def _forecast_columns(means: DataFrame, value_cols: Sequence[str]) -> dict[str, Column]:
    built = {}
    for c in value_cols:
        diff = F.col(f"_p_{c}") - F.col(f"_h_{c}")
        built[f"anomaly_forecast_{c}"] = diff
        built[f"anomaly_forecast_scaled_{c}"] = ratio(diff, F.col(f"_d_{c}"), F.col(f"_h_{c}"))
    return built


def _recorded_columns(value_cols: Sequence[str]) -> dict[str, Column]:
    built = {}
    for c in value_cols:
        diff = F.col(f"_r_{c}") - F.col(f"_h_{c}")
        built[f"anomaly_recorded_{c}"] = diff
        built[f"anomaly_recorded_scaled_{c}"] = ratio(diff, F.col(f"_d_{c}"), F.col(f"_h_{c}"))
    return built


def _compared_columns(value_cols: Sequence[str]) -> dict[str, Column]:
    built = {}
    for c in value_cols:
        for scaled in ("", "scaled_"):
            name = f"anomaly_{c}" + ("_scaled" if scaled else "")
            f, r = F.col(f"anomaly_forecast_{scaled}{c}"), F.col(f"anomaly_recorded_{scaled}{c}")
            built |= {f"{name}_forecast": f, f"{name}_recorded": r, f"{name}_difference": f - r}
    return built


def forecast_anomalies(
    forecast: DataFrame,
    clim: DataFrame,
    dates: DataFrame,
    breaks: Sequence[int] = (0, 30, 60, 90, 120, 150),
    value_cols: Sequence[str] = WEATHER,
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Forecast minus climatology over each interval after each date, raw and scaled.

    Means run over the days of the interval: the climatology of the day, and the forecast (latest issue not after
    the date) of the day's month.  Daily rows are never built.  An interval is one or two month segments; the forecast
    is constant inside a segment, so its daily mean is a mean weighted by the segment's days.  The scaled anomaly
    divides by the mean of the daily deviations.

    Climatology and forecast meet once, as one row a cell (:mod:`fieldgrid.plans.cells`); the calendar of dates,
    intervals and months travels to the tasks, and what comes out is not shuffled again.
    """
    keys = list(keys)
    issues = latest_at_or_before(dates, forecast.select("base_date"))
    calendar = Calendar.of(interval_segments(dates, breaks).join(issues, "date"))
    rows = packed(keys, _clim=_climate_part(clim, value_cols), _lead=_lead_part(forecast, value_cols))
    means = interval_means(rows, keys, calendar, value_cols, True, None)
    built = _forecast_columns(means, value_cols)
    out = with_date_parts(means.select(*keys, "date", F.col("hi").alias("forecast_interval"), *[v.alias(k) for k, v in built.items()]))
    return out.select(*keys, "date", "doy", "month", "year", "forecast_interval", *built)


def recorded_anomalies(
    daily: DataFrame,
    clim: DataFrame,
    dates: DataFrame,
    breaks: Sequence[int],
    value_cols: Sequence[str] = WEATHER,
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """What was recorded over each interval: mean of the daily values minus mean of the daily climatology.

    One row per cell of the climatology, date and interval.  The recorded mean is NULL when a day of the cell is
    NULL or the cell has no day in the interval.
    """
    keys = list(keys)
    calendar = Calendar.of(interval_segments(dates, breaks))
    rows = packed(keys, _clim=_climate_part(clim, value_cols), _seen=_seen_part(daily, value_cols, keys))
    means = interval_means(rows, keys, calendar, value_cols, False, _recorded_days(calendar, breaks))
    return means.select(*keys, "date", F.col("hi").alias("forecast_interval"), *[v.alias(k) for k, v in _recorded_columns(value_cols).items()])


def forecast_and_recorded(
    forecast: DataFrame,
    daily: DataFrame,
    clim: DataFrame,
    dates: DataFrame,
    breaks: Sequence[int] = (0, 30, 60, 90, 120, 150),
    value_cols: Sequence[str] = WEATHER,
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Forecast anomaly, recorded anomaly and their difference, one row per cell, date and interval.

    The same as :func:`validate_forecast` of :func:`forecast_anomalies`, in one pass: calendar and climatology are added
    up once for both sides, which meet in the cell's row instead of a join.
    """
    keys = list(keys)
    issues = latest_at_or_before(dates, forecast.select("base_date"))
    calendar = Calendar.of(interval_segments(dates, breaks).join(issues, "date"))
    rows = packed(keys, _clim=_climate_part(clim, value_cols), _lead=_lead_part(forecast, value_cols), _seen=_seen_part(daily, value_cols, keys))
    means = interval_means(rows, keys, calendar, value_cols, True, _recorded_days(calendar, breaks))
    both = means.withColumns(_forecast_columns(means, value_cols) | _recorded_columns(value_cols))
    return both.select(*keys, "date", F.col("hi").alias("forecast_interval"), *[v.alias(k) for k, v in _compared_columns(value_cols).items()])


def validate_forecast(
    forecast_anom: DataFrame,
    daily: DataFrame,
    clim: DataFrame,
    dates: DataFrame,
    breaks: Sequence[int] = (0, 30, 60, 90, 120, 150),
    value_cols: Sequence[str] = WEATHER,
    keys: Sequence[str] = CELL,
    wide: bool = True,
) -> DataFrame:
    """Forecast anomaly next to the recorded anomaly of the same interval, and their difference.

    ``wide`` gives one row per cell and date with ``anomaly_{v}[_scaled]_{forecast|recorded|difference}_{end}``
    columns, ``end`` being the last day of the interval; otherwise one row per interval.
    """
    keys = list(keys)
    wanted = forecast_anom.join(calendar_side(dates.select("date").distinct()), "date", "left_semi")
    recorded = recorded_anomalies(daily, clim, dates, breaks, value_cols, keys)
    if wide:
        return _validated_wide(wanted, recorded, breaks, value_cols, keys)
    joined = wanted.join(recorded, [*keys, "date", "forecast_interval"], "left")
    built = _compared_columns(value_cols)
    return joined.select(*keys, "date", "forecast_interval", *[v.alias(k) for k, v in built.items()])


def _validated_wide(wanted: DataFrame, recorded: DataFrame, breaks: Sequence[int], value_cols: Sequence[str], keys: list[str]) -> DataFrame:
    """Both sides to one row per cell and date first: they meet where these rows are, and only their own columns travel.

    The recorded side has one row per cell, date and interval, so the largest difference is that of the largest forecast.
    """

    def spread_out(rows: DataFrame, side: str) -> DataFrame:
        cells = []
        for end in breaks[1:]:
            here = F.col("forecast_interval") == end
            cells.append(F.max(here).alias(f"_{side}_{end}"))  # an interval without a forecast shows nothing recorded
            for scaled in ("", "scaled_"):
                cells += [F.max(F.when(here, F.col(f"anomaly_{side}_{scaled}{c}"))).alias(f"_{side}_{scaled}{c}_{end}") for c in value_cols]
        return rows.groupBy(*keys, "date").agg(*cells)

    joined = spread_out(wanted, "forecast").join(spread_out(recorded, "recorded"), [*keys, "date"], "left")
    built = []
    for end in breaks[1:]:
        for c in value_cols:
            for scaled in ("", "scaled_"):
                name = f"anomaly_{c}" + ("_scaled" if scaled else "")
                f, r = F.col(f"_forecast_{scaled}{c}_{end}"), F.when(F.col(f"_forecast_{end}"), F.col(f"_recorded_{scaled}{c}_{end}"))
                built += [f.alias(f"{name}_forecast_{end - 1}"), r.alias(f"{name}_recorded_{end - 1}"), (f - r).alias(f"{name}_difference_{end - 1}")]
    return joined.select(*keys, "date", *built)


def map_view(wide: DataFrame, variable: str, kind: str, period: int, date, domain: Sequence[float]) -> DataFrame:
    """One map layer: the chosen anomaly of one date, limited to the display domain."""
    from ..functions.columns import clamp

    name = f"anomaly_{variable}_{kind}_{period}" if kind else f"anomaly_{variable}_{period}"
    if name not in wide.columns:
        raise ValueError(f"no column {name}")
    return wide.where(F.col("date") == F.lit(date).cast("date")).select(
        "ix", "iy", clamp(F.col(name), min(domain), max(domain)).alias(name)
    )
