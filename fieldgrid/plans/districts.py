"""District training table: lags over available dates, imputed soil, labels, district means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.aggregates import mean
from ..functions.columns import columns_matching, quoted, recode, relocate
from ..operators.joins import join_or_zero, previous_available
from ..operators.nearest import fill_nearest
from ..session import calendar_side, cut

# Drainage classes from excessively to very poorly drained.
DRAINAGE_ORDER = {"E": 1, "SE": 2, "W": 3, "MW": 4, "I": 5, "P": 6, "VP": 7}


def lag_columns(df: DataFrame) -> list[str]:
    """Columns to lag: recorded anomalies, not forecast ones."""
    return columns_matching(df, contains="anomaly", without="forecast")


def lag_means_by_available_dates(
    df: DataFrame,
    columns: Sequence[str],
    buckets: Sequence[tuple[int, int]] = ((30, 1), (60, 31), (90, 61)),
    keys: Sequence[str] = ("ix", "iy"),
    date: str = "date",
    available: DataFrame | None = None,
) -> DataFrame:
    """Means of each column over the sampled dates in ``[date - far, date - near]``: ``{column}_{far}``.

    * A bucket without any sampled date (in the whole data) takes the latest sampled date strictly before
      ``date - near`` instead.
    * A date for which some bucket has no such earlier date is dropped.
    * A NULL among the rows of a bucket makes its mean NULL.

    One shuffle: rows become daily sums per key, and bucket means and fallback values are frames of one ordering.
    Which buckets are empty depends on the calendar of distinct dates only, a small table joined by date.  It is
    taken from ``available`` or, by one pass over the date column, from ``df``.
    """
    keys = list(keys)
    days = cut((df if available is None else available).select(date).distinct())
    calendar = days.withColumn("_n", F.unix_date(date))
    w = Window.orderBy("_n")
    nears = [near for _, near in buckets]
    calendar = calendar.withColumns(
        {f"_filled_{far}": F.count(F.lit(1)).over(w.rangeBetween(-far, -near)) > 0 for far, near in buckets}
    ).drop("_n")
    calendar = calendar.join(previous_available(days, nears, date), date)
    rule: Column = F.lit(True)
    for near in nears:
        rule = rule & F.col(f"before_{near}").isNotNull()
    calendar = calendar.withColumn("_usable", rule)

    daily = df.groupBy(*keys, date).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(quoted(c)).alias(f"_s_{c}") for c in columns],
        *[F.count(quoted(c)).alias(f"_n_{c}") for c in columns],
    )
    per_cell = Window.partitionBy(*keys).orderBy(F.unix_date(date))
    whole = F.struct(F.col(date).alias("d"), F.col("_rows").alias("r"), *[F.col(f"_{p}_{c}") for c in columns for p in "sn"])
    cells = daily.join(calendar_side(calendar), date)
    frames = {}
    for far, near in buckets:
        inside = per_cell.rangeBetween(-far, -near)
        frames[f"_rows_{far}"] = F.sum("_rows").over(inside)
        for c in columns:
            frames[f"_s_{c}_{far}"] = F.sum(f"_s_{c}").over(inside)
            frames[f"_n_{c}_{far}"] = F.sum(f"_n_{c}").over(inside)
        frames[f"_last_{far}"] = F.max_by(whole, F.col(date)).over(per_cell.rangeBetween(Window.unboundedPreceding, -(near + 1)))
    cells = cells.withColumns(frames).where("_usable")
    out = {}
    for far, near in buckets:
        last = F.col(f"_last_{far}")
        is_fallback = last["d"] == F.col(f"before_{near}")
        for c in columns:
            bucket = F.when(
                F.col(f"_n_{c}_{far}") == F.col(f"_rows_{far}"), F.try_divide(F.col(f"_s_{c}_{far}"), F.col(f"_n_{c}_{far}"))
            )
            one = F.when(is_fallback & (last[f"_n_{c}"] == last["r"]), F.try_divide(last[f"_s_{c}"], last[f"_n_{c}"]))
            out[f"{c}_{far}"] = F.when(F.col(f"_filled_{far}"), bucket).otherwise(one)
    return cells.select(*keys, date, *[v.alias(k) for k, v in out.items()])


def impute_soil(df: DataFrame, columns: Sequence[str] = ("soil_drainage", "soil_texture")) -> DataFrame:
    """Unknown soil classes take the nearest known cell's class; drainage becomes ordinal, texture numeric."""
    known = df.withColumns({c: F.nullif(F.col(c), F.lit("UNK")) for c in columns})
    filled = fill_nearest(known, columns)
    built = {}
    for c in columns:
        built[c] = recode(F.col(c), DRAINAGE_ORDER).cast("double") if "drainage" in c else F.col(c).try_cast("double")
    return filled.withColumns(built)


def district_features(
    df: DataFrame,
    response: DataFrame,
    region_col: str = "region",
    buckets: Sequence[tuple[int, int]] = ((30, 1), (60, 31), (90, 61)),
    drop: Sequence[str] = ("slope", "aspect"),
    dates: DataFrame | None = None,
) -> DataFrame:
    """Region-masked predictors to the training table, one row per district, date and forecast interval.

    Soil is imputed, recorded anomalies are replaced by their lags, cases are joined (0 where absent), and every
    numeric column is averaged over the district's cells; a NULL cell makes that district's mean NULL.
    ``outbreak`` is 1 when the mean of cases is above 0.  ``dates`` names the sampled dates of ``df`` when they are
    known, which saves reading them from it.
    """
    keys = ["ix", "iy", region_col]
    lagging = lag_columns(df)
    lags = lag_means_by_available_dates(df.select(*keys, "date", *lagging), lagging, buckets, keys, available=dates)
    static = df.drop(*lagging, *[c for c in drop if c in df.columns])
    soil = [c for c in ("soil_drainage", "soil_texture") if c in static.columns]
    if soil:
        static = impute_soil(static, soil)
    rows = static.join(lags, [*keys, "date"], "inner")
    labels = response.groupBy("ix", "iy", "date", "forecast_interval").agg(F.sum("cases").alias("cases"))
    rows = join_or_zero(rows, labels, ["ix", "iy", "date", "forecast_interval"], ["cases"])
    group = [region_col, "date", "forecast_interval"]
    unused = {"ix", "iy", "x", "y", "doy", "month", "year", *group}
    numeric = [f.name for f in rows.schema if isinstance(f.dataType, NumericType) and f.name not in unused]
    out = rows.groupBy(*group).agg(*[mean(quoted(c), na_rm=False).alias(c) for c in numeric])
    out = out.withColumn("outbreak", F.when(F.col("cases") > 0, 1).otherwise(0))
    return relocate(out, [*group, "cases", "outbreak"])
