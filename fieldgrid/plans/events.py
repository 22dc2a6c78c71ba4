"""Outbreak events: cleaning, interval labels, flags, history weights and spread."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import global_range, total
from ..functions.dates import interval_table, with_date_parts
from ..operators.grid import GridSpec, with_dates
from ..operators.nearest import KM_PER_DEGREE, cells_within
from ..operators.ranks import row_numbers
from ..operators.regions import match_points
from ..operators.windows import with_group_stats
from ..session import calendar_side, spread

DAYS_PER_YEAR = 365.25
_ANCHOR = 10957  # 2000-01-01 as a day number; keeps the decay exponents small


def clean_outbreaks(
    raw: DataFrame, countries: DataFrame, disease: str = "rift valley fever", continent: str = "Africa"
) -> DataFrame:
    """Outbreaks of one disease on one continent with both dates filled, distinct, and a surrogate id.

    ``countries`` maps ``iso_code`` to ``continent``.  Ids follow (end_date, latitude, longitude, cases,
    start_date), which is a total order over distinct rows.
    """
    rows = raw.where(F.lower("standardized_disease_name") == disease.lower()).withColumn(
        "iso_code", F.upper("country_unique_code")
    )
    wanted = countries.where(F.lower("continent") == continent.lower()).select("iso_code")
    rows = rows.join(wanted, "iso_code", "left_semi")
    tidy = rows.select(
        F.col("cases").cast("int").alias("cases"),
        F.coalesce("outbreak_start_date", "outbreak_end_date").alias("start_date"),
        F.coalesce("outbreak_end_date", "outbreak_start_date").alias("end_date"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    ).distinct()
    out = row_numbers(tidy, ["end_date", "latitude", "longitude", "cases", "start_date"], "outbreak_id")
    return out.withColumn("outbreak_id", F.col("outbreak_id").cast("int"))


def clean_controls(raw: DataFrame, countries: DataFrame, disease: str = "rift valley fever", continent: str = "Africa") -> DataFrame:
    """Control measures: one country spelling repaired, then country name -> code and continent."""
    rows = raw.where(F.lower("standardized_disease_name") == disease.lower())
    name = F.when(F.col("country") == "central african (rep.)", "central african republic").otherwise(F.col("country"))
    lookup = countries.select(F.lower("country").alias("country"), "iso_code", "continent")
    return rows.withColumn("country", F.lower(name)).join(lookup, "country").where(
        F.lower("continent") == continent.lower()
    )


def outbreak_response(outbreaks: DataFrame, grid: GridSpec, dates: DataFrame, breaks: Sequence[int] = (1, 30, 60, 90, 120, 150)) -> DataFrame:
    """Cases of outbreaks starting in ``[date + lo, date + hi)`` per cell, date and interval (labelled ``hi``).

    Events are summed per cell and start day first.  The range condition becomes an equi join: the calendar lists,
    for every start day, the (date, interval) pairs it counts for.  Cells without an outbreak have no row.
    """
    cells = grid.snap(outbreaks.where(F.col("start_date").isNotNull())).where(F.col("ix").isNotNull())
    daily = cells.groupBy("ix", "iy", "start_date").agg(F.sum("cases").alias("cases"))
    spans = with_dates(interval_table(dates.sparkSession, breaks), dates)
    calendar = spans.withColumn(
        "start_date", F.explode(F.sequence(F.expr("date_add(date, lo)"), F.expr("date_add(date, hi - 1)")))
    )
    out = daily.join(calendar_side(calendar), "start_date").groupBy("ix", "iy", "date", F.col("hi").alias("forecast_interval"), "lo").agg(
        total(F.col("cases")).cast("double").alias("cases")
    )
    return out.select(
        "ix",
        "iy",
        "date",
        "forecast_interval",
        F.date_add("date", F.col("lo")).alias("forecast_start"),
        F.date_add("date", F.col("forecast_interval")).alias("forecast_end"),
        "cases",
    )


def outbreak_flag(outbreaks: DataFrame, regions: DataFrame, dates: DataFrame, lo: int = 1, hi: int = 30, region: str = "region") -> DataFrame:
    """Regions with an outbreak strictly inside their outline starting ``lo..hi`` days after each date."""
    places = outbreaks.select("longitude", "latitude", "start_date").distinct()
    inside = match_points(places, regions, "longitude", "latitude", region, boundary=False)
    starts = inside.select(region, "start_date").distinct()
    days = dates.select("date").distinct().withColumn(
        "start_date", F.explode(F.sequence(F.date_add("date", lo), F.date_add("date", hi)))
    )
    return starts.join(calendar_side(days), "start_date").select("date", region).distinct().withColumn(f"outbreak_{hi}", F.lit(True))


def distance_weights(
    outbreaks: DataFrame, grid: GridSpec, within_km: float = 500.0, beta_dist: float = 0.01, ellipsoid: bool = False
) -> DataFrame:
    """Sparse cell x outbreak weights ``exp(-beta_dist * km)`` up to ``within_km``, on the sphere or the ellipsoid."""
    near = cells_within(outbreaks, grid, within_km, ellipsoid=ellipsoid)
    return near.withColumn("w", F.exp(F.lit(-beta_dist) * F.col("km"))).drop("km")


def _told_apart(dates: DataFrame, ages: Sequence[int]) -> DataFrame:
    """``_event_day, _day``: for each day before the last date, the last day that reaches the same ages at the same dates.

    A calendar, whatever the number of events.
    """
    asked = F.unix_date("date")
    marks = dates.select(F.explode(F.array(*[asked - a for a in ages])).alias("_event_day")).distinct().withColumn("_mark", F.col("_event_day"))
    first, last = F.unix_date(F.min("date")) - max(ages), F.unix_date(F.max("date"))
    span = dates.agg(F.sequence(first, last).alias("_days")).select(F.explode("_days").alias("_event_day"))
    later = Window.orderBy("_event_day").rowsBetween(0, Window.unboundedFollowing)
    days = span.join(marks, "_event_day", "left").select("_event_day", F.min("_mark").over(later).alias("_day"))
    return days.where(F.col("_day").isNotNull())


def outbreak_history(
    dates: DataFrame,
    outbreaks: DataFrame,
    grid: GridSpec,
    beta_time: float = 0.5,
    beta_dist: float = 0.01,
    within_km: float = 500.0,
    max_years: float = 10.0,
    recent: float = 3 / 12,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Decayed outbreak pressure per cell and date, split in recent and old events; 0 where there is none.

    An event weighs ``(log10(cases + 1) or 1) * exp(-beta_time * years) * exp(-beta_dist * km)`` and counts while
    ``0 < age`` and ``years < max_years``.  Only events strictly before the date are used.

    The time decay factorises, and days that no asked date tells apart (as it starts to count, turns old, or expires)
    are one: events at one place and such a day are merged first; each then touches the cells in reach once, for all
    dates.  Events are placed by day and tile of about the reach, so that what they add to a cell is added up before it
    moves.  An impulse starts to count the day after, turns old, and expires; recent and old pressure are differences of
    the running totals of these three moments.  The totals add the same terms in the same order, so a window without
    events gives exactly 0.  Work is linear in impulses plus cell-days asked for: no date x event pairs and no sliding
    frames.
    """
    decay = F.lit(beta_time / DAYS_PER_YEAR)
    oldest = math.ceil(max_years * DAYS_PER_YEAR) - 1  # last age in days that counts
    split = min(math.ceil(recent * DAYS_PER_YEAR) - 1, oldest)  # last age that is still recent
    first_day = dates.agg(F.unix_date(F.min("date"))).scalar()
    last_day = dates.agg(F.unix_date(F.max("date"))).scalar()
    weight = F.when(F.col("cases").isNull(), F.lit(1.0)).otherwise(F.log10(F.col("cases") + F.lit(1.0)))
    day = F.unix_date("start_date")
    in_reach = outbreaks.where((day < last_day) & (day >= first_day - F.lit(oldest)))
    ages = (1, split + 1, oldest + 1)
    grown = weight * F.exp(decay * (day - F.lit(_ANCHOR)))
    known = in_reach.select("longitude", "latitude", day.alias("_event_day"), grown.alias("_cw")).join(calendar_side(_told_apart(dates, ages)), "_event_day")
    merged = known.groupBy("longitude", "latitude", "_day").agg(F.sum("_cw").alias("_cw"))
    size = F.lit(max(within_km / KM_PER_DEGREE, grid.res))
    tiles = {"_tx": F.floor(F.col("longitude") / size), "_ty": F.floor(F.col("latitude") / size)}
    placed = spread(merged.withColumns(tiles), "_tx", "_ty", "_day")  # each event becomes thousands of cells
    near = distance_weights(placed, grid, within_km, beta_dist)
    near = near.groupBy("_tx", "_ty", "_day", "ix", "iy").agg(F.sum(F.col("_cw") * F.col("w")).alias("_w"))
    # Placed by cell once: daily impulses, their moments and the running totals all stay there.
    impulses = spread(near.drop("_tx", "_ty"), "ix", "iy").groupBy("ix", "iy", "_day").agg(F.sum("_w").alias("_w"))
    scaled = F.col("_w")
    none = F.lit(None).cast("double")
    moments = F.array(
        *[
            F.struct(
                (F.col("_day") + age).alias("_day"), *[(scaled if i == k else none).alias(f"_m{i}") for i in range(3)]
            )
            for k, age in enumerate(ages)
        ]
    )
    impulses = impulses.select("ix", "iy", F.inline(moments)).where(F.col("_day") <= last_day)
    cells = (cells if cells is not None else grid.cells(dates.sparkSession)).select("ix", "iy")
    asked = with_dates(spread(cells, "ix", "iy"), dates).withColumn("_day", F.unix_date("date"))
    both = asked.unionByName(impulses, allowMissingColumns=True)
    upto = Window.partitionBy("ix", "iy").orderBy("_day").rangeBetween(Window.unboundedPreceding, 0)
    total_at = [F.coalesce(F.sum(f"_m{i}").over(upto), F.lit(0.0)) for i in range(3)]
    both = both.withColumns({f"_t{i}": total_at[i] for i in range(3)}).where(F.col("date").isNotNull())
    back = F.exp(-decay * (F.col("_day") - F.lit(_ANCHOR)))
    out = with_date_parts(
        both.withColumns(
            {
                "outbreak_history_weight_recent": (F.col("_t0") - F.col("_t1")) * back,
                "outbreak_history_weight_old": (F.col("_t1") - F.col("_t2")) * back,
            }
        )
    )
    return out.select(
        "ix", "iy", "date", "doy", "month", "year", "outbreak_history_weight_recent", "outbreak_history_weight_old"
    )


def history_metadata(history: DataFrame) -> DataFrame:
    """Years of the history with the overall weight range on each row."""
    weights = [c for c in history.columns if "weight" in c]
    span = history.agg(F.struct(*global_range(weights))).scalar()
    years = history.select("year").distinct().withColumn("_r", span)
    return years.select("year", F.col("_r.min").alias("min"), F.col("_r.max").alias("max"))


def history_long(history: DataFrame) -> DataFrame:
    """One row per time frame (``recent`` / ``old``), named from the weight columns."""
    weights = [c for c in history.columns if "weight" in c]
    ids = [c for c in history.columns if c not in weights]
    long = history.unpivot(ids, weights, "time_frame", "weight")
    return long.withColumn("time_frame", F.regexp_extract("time_frame", r".*_(.*)", 1))


def outbreak_spread(points: DataFrame, event: str = "epi_event_id", start: str = "outbreak_start_date") -> DataFrame:
    """Days since the first report of each event, origin flag, and whether the event has a single report."""
    rows = with_group_stats(points, [event], _first=F.min(start), _n=F.count(F.lit(1)))
    out = rows.withColumns(
        {
            "days": F.date_diff(F.col(start), F.col("_first")),
            "origin_loc": F.col(start) == F.col("_first"),
            "single_outbreak": F.when(F.col("_n") == 1, "Single Outbreak").otherwise("Outbreak Origin"),
            "label": F.date_format("_first", "yyyy-MM-dd"),
        }
    ).drop("_first", "_n")
    out = out.withColumns({c: F.col(c).cast("double") for c in ("longitude", "latitude")})
    return out.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
