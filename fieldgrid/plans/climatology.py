"""Day-of-year climatology, anomalies, yearly summaries and composite series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import CELL
from ..functions.aggregates import five_numbers, mean, means_and_sds
from ..functions.climate import NDVI_SCALE, scale_by_source
from ..functions.columns import all_present, drop_incomplete, ratio
from ..functions.dates import expand_range, with_date_parts
from ..operators.joins import join_all
from ..operators.nearest import fill_nearest
from ..operators.windows import interval_ends, interval_gaps
from ..session import calendar_side, spread


def climatology(
    daily: DataFrame, value_cols: Sequence[str], keys: Sequence[str] = CELL, require_sd: bool = False, date: str = "date"
) -> DataFrame:
    """Mean and sample deviation per cell and day of year over all years, NULLs skipped, in one pass.

    Day 366 is its own group.  ``require_sd`` drops groups whose deviation is undefined (a single observation).
    """
    rows = daily if "doy" in daily.columns else with_date_parts(daily, date, ["doy"])
    out = rows.groupBy(*keys, "doy").agg(*means_and_sds(value_cols))
    if require_sd:
        out = out.where(all_present([f"{c}_sd" for c in value_cols]))
    return out


def yearly_moments(daily: DataFrame, value_cols: Sequence[str], keys: Sequence[str] = CELL, date: str = "date") -> DataFrame:
    """State of a climatology: ``n_v, mean_v, m2_v`` (sum of squared deviations) per cell, day of year and year.

    A year's state depends on that year's rows only, so it is written once (by year, say) and a new year adds its own.
    """
    rows = with_date_parts(daily, date, ["doy", "year"])
    parts = []
    for c in value_cols:
        parts += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), (F.var_pop(c) * F.count(c)).alias(f"m2_{c}")]
    return rows.groupBy(*keys, "doy", "year").agg(*parts)


def climatology_from_moments(
    moments: DataFrame, value_cols: Sequence[str], keys: Sequence[str] = CELL, require_sd: bool = False
) -> DataFrame:
    """The climatology of all years in ``moments``, the same as :func:`climatology` of their days.

    Years are merged one after another in order, each by its distance from the mean so far, so a large common offset
    costs no digits and the result does not depend on partitions.  A group holds one entry a year.
    """
    state = lambda c: F.struct(F.col("year").alias("year"), *[F.col(f"{k}_{c}").alias(k) for k in ("n", "mean", "m2")])
    years = moments.groupBy(*keys, "doy").agg(*[F.sort_array(F.collect_list(state(c))).alias(f"_{c}") for c in value_cols])

    def merge(a, b):
        n = a["n"] + b["n"]
        off = b["mean"] - a["mean"]
        both = F.struct(
            n.alias("n"),
            (a["mean"] + off * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + off * off * a["n"] * b["n"] / n).alias("m2"),
        )
        return F.when(b["n"] == 0, a).when(a["n"] == 0, F.struct(b["n"].alias("n"), b["mean"].alias("mean"), b["m2"].alias("m2"))).otherwise(both)

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    merged = years.select(*keys, "doy", *[F.aggregate(f"_{c}", start, merge).alias(c) for c in value_cols])
    out = []
    for c in value_cols:
        n, m = F.col(f"{c}.n"), F.col(f"{c}.m2")
        out += [F.when(n > 0, F.col(f"{c}.mean")).alias(c), F.when(n > 1, F.sqrt(m / (n - 1))).alias(f"{c}_sd")]
    result = merged.select(*keys, "doy", *out)
    return result.where(all_present([f"{c}_sd" for c in value_cols])) if require_sd else result


def _anomaly_columns(value_cols: Sequence[str], clim: Mapping[str, str], sd: Mapping[str, str]) -> dict:
    out = {}
    for c in value_cols:
        diff = F.col(c) - F.col(clim[c])
        out[f"anomaly_{c}"] = diff
        out[f"anomaly_scaled_{c}"] = ratio(diff, F.col(sd[c]), F.col(clim[c]))
    return out


def anomalies(
    daily: DataFrame,
    clim: DataFrame,
    value_cols: Sequence[str],
    dates: DataFrame | None = None,
    drop_null: bool = True,
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """``anomaly_v = v - mean`` and ``anomaly_scaled_v = anomaly_v / sd`` against a stored climatology.

    ``drop_null`` (weather form) keeps only rows whose values, means and deviations are all present; otherwise
    (vegetation form) rows stay and the anomalies are NULL.  A zero deviation gives a NULL scaled anomaly.
    """
    keys = list(keys)
    rows = daily.select(*keys, "date", *value_cols)
    if dates is not None:
        rows = rows.join(calendar_side(dates.select("date").distinct()), "date", "left_semi")
    rows = with_date_parts(rows)
    ref = clim.select(*keys, "doy", *value_cols, *[f"{c}_sd" for c in value_cols])
    if drop_null:
        rows, ref = drop_incomplete(rows), drop_incomplete(ref)
    ref = ref.withColumnsRenamed({c: f"{c}_historical" for c in value_cols})
    joined = rows.join(ref, [*keys, "doy"], "inner" if drop_null else "left")
    built = _anomaly_columns(value_cols, {c: f"{c}_historical" for c in value_cols}, {c: f"{c}_sd" for c in value_cols})
    return joined.withColumns(built).select(*keys, "date", "doy", "month", "year", *built)


def own_anomalies(
    daily: DataFrame, value_cols: Sequence[str], drop_null: bool = True, keys: Sequence[str] = CELL
) -> DataFrame:
    """:func:`climatology` and :func:`anomalies` of the same series with a single shuffle.

    ``daily`` must hold one row per cell and date; a window group is then one cell and day of year, i.e. at most
    one row per year, and the join back to the climatology disappears.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, "doy")
    rows = with_date_parts(daily.select(*keys, "date", *value_cols))
    stats = {f"_m_{c}": F.avg(c).over(w) for c in value_cols} | {f"_s_{c}": F.stddev_samp(c).over(w) for c in value_cols}
    rows = rows.withColumns(stats)
    if drop_null:
        rows = rows.where(all_present([*value_cols, *stats]))
    built = _anomaly_columns(value_cols, {c: f"_m_{c}" for c in value_cols}, {c: f"_s_{c}" for c in value_cols})
    return rows.withColumns(built).select(*keys, "date", "doy", "month", "year", *built)


def expand_composites(
    df: DataFrame,
    source: str | None = None,
    start: str = "start_date",
    end: str = "end_date",
    place: Sequence[str] = CELL,
) -> DataFrame:
    """Step function to daily rows: the composite value holds on every day of ``[start, end]``.

    Composites are placed by cell before they are repeated, so that grouping the many daily rows by cell and day
    (:func:`fuse_sources`) needs no second shuffle.
    """
    if place:
        df = spread(df, *place)
    out = with_date_parts(expand_range(df, start, end), "date")
    out = out.drop(start, end)
    return out if source is None else out.withColumn("source", F.lit(source))


def fuse_sources(
    sources: Mapping[str, DataFrame], scale: Mapping[str, float] | None = None, value: str = "ndvi", keys: Sequence[str] = CELL
) -> DataFrame:
    """Scale each source and average the sources (and overlapping composites) that share a cell and day.

    A NULL in the group makes its mean NULL.
    """
    stacked = None
    for name, df in sources.items():
        part = df.select(*keys, "date", F.col(value).alias(value), F.lit(name).alias("source"))
        stacked = part if stacked is None else stacked.unionByName(part)
    scaled = stacked.withColumn(value, scale_by_source(F.col(value), F.col("source"), dict(scale or NDVI_SCALE)))
    fused = scaled.groupBy(*keys, "date").agg(mean(F.col(value), na_rm=False).alias(value))
    return with_date_parts(fused).select(*keys, "date", "doy", "month", "year", value)


def composite_date_lookup(
    primary: DataFrame,
    fallback: DataFrame,
    names: tuple[str, str] = ("sentinel", "modis"),
    primary_from_year: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Which source serves which day, without overlap: ``(lookup, problems)``.

    ``primary`` has ``start_date, end_date``, ``fallback`` has ``start_date``.  Every interval is closed the day
    before the next one; the last primary interval keeps its reported end and the last fallback interval is
    dropped.  Fallback days end where the primary source begins.  ``problems`` lists days served twice and days
    inside the covered range that nothing serves.
    """
    first = primary.select("start_date", F.col("end_date").alias("reported_end")).distinct()
    if primary_from_year is not None:
        first = first.where(F.year("start_date") >= primary_from_year)
    first = interval_ends(first, last=F.col("reported_end"))
    begins = first.agg(F.min("start_date")).scalar()
    second = interval_ends(fallback.select("start_date").distinct(), last=F.lit(None).cast("date"))
    days = lambda df: df.where(F.col("start_date") <= F.col("end_date")).withColumn(
        "lookup_dates", F.sequence("start_date", "end_date")
    )
    lead = days(first).select(F.lit(names[0]).alias("satellite"), "start_date", "lookup_dates")
    back = days(second).withColumn("_begins", begins)
    back = back.withColumn(
        "lookup_dates", F.filter("lookup_dates", lambda d: F.col("_begins").isNull() | (d < F.col("_begins")))
    )
    back = back.where(F.size("lookup_dates") > 0).select(F.lit(names[1]).alias("satellite"), "start_date", "lookup_dates")
    lookup = back.unionByName(lead).withColumn(
        "lookup_day_of_year", F.transform("lookup_dates", lambda d: F.dayofyear(d))
    )
    served = lookup.select(F.explode("lookup_dates").alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    bounds = served.agg(F.min("date").alias("a"), F.max("date").alias("b")).where(F.col("a").isNotNull())
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    problems = (
        spine.join(served, "date", "left")
        .select("date", F.coalesce("n", F.lit(0)).alias("n"))
        .where(F.col("n") != 1)
        .select("date", F.when(F.col("n") == 0, "missing").otherwise("overlap").alias("problem"))
    )
    return lookup, problems


def reported_overlaps(intervals: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Gap and overlap flags between the reported end of each interval and the next start."""
    return interval_gaps(intervals, within=within)


def yearly_summary(df: DataFrame, column: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean, sd, min, max and range per cell and year, then their means over the years: ``{column}_{stat}``.

    A NULL makes the statistics of its year, and with them those of the cell, NULL (to be imputed later).
    """
    rows = df if "year" in df.columns else with_date_parts(df, "date", ["year"])
    yearly = rows.groupBy(*keys, "year").agg(*five_numbers(column, na_rm=False))
    stats = ["mean", "sd", "min", "max", "range"]
    return yearly.groupBy(*keys).agg(*[mean(F.col(s), na_rm=False).alias(f"{column}_{s}") for s in stats])


def combined_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = CELL, impute: bool = False) -> DataFrame:
    """Yearly summaries of several columns joined per cell, optionally with NULLs filled from the nearest cell."""
    out = join_all([yearly_summary(df, c, keys) for c in columns], keys)
    if impute:
        out = fill_nearest(out, [c for c in out.columns if c not in keys])
    return out
