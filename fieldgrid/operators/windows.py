"""Ordered operators: interval ends, gaps, day-range frames, keep-first and keep-latest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate_named
from .ranks import ordered_ranges


def interval_ends(
    df: DataFrame,
    start: str = "start_date",
    end: str = "end_date",
    within: Sequence[str] = (),
    last: Column | None = None,
) -> DataFrame:
    """Close each interval the day before the next start; the last one ends at ``last`` (default: start + 15).

    The window runs over composite records (one per composite and source), never over pixels.
    """
    w = Window.partitionBy(*within).orderBy(start)
    closing = F.date_sub(F.lead(start).over(w), 1)
    fallback = F.date_add(F.col(start), 15) if last is None else last
    return df.withColumn(end, F.coalesce(closing, fallback))


def interval_gaps(df: DataFrame, start: str = "start_date", end: str = "end_date", within: Sequence[str] = ()) -> DataFrame:
    """Days to the next start, overlap with it, and flags for missing days and for shared days."""
    w = Window.partitionBy(*within).orderBy(start)
    nxt = F.lead(start).over(w)
    return df.withColumns(
        {
            "start_diff": F.date_diff(nxt, F.col(start)),
            "overlap": F.date_diff(F.col(end), nxt),
        }
    ).withColumns({"has_gap": F.col("overlap") < -1, "has_overlap": F.col("overlap") > 0})


def covered_until(
    df: DataFrame,
    start: str = "start_date",
    end: str = "end_date",
    within: Sequence[str] = (),
    tie: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Gaps to and overlaps with any earlier interval, not only the one before: a sweep along the starts.

    Adds ``covered_until``, the latest end of all intervals of the group that start earlier (or at the same day and come
    first by end, then by ``tie``), ``gap_days`` between it and the start, ``overlap_days`` that are covered already, ``has_gap`` and
    ``has_overlap``.  The first interval of a group has NULLs and is neither.  Intervals are placed in ranges and the
    maximum is carried from range to range, so one long group, or no groups at all, is no single task.
    """
    place = ordered_ranges(df, [*within, start, end, *tie], ranges)
    inside = Window.partitionBy("_range", *within).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = place.groupBy("_range", *within).agg(F.max(end).alias("_most"))
    carried = carried.select("_range", *within, F.max("_most").over(earlier).alias("_before"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("_range", *within)]
    rule = same[0]
    for s in same[1:]:
        rule = rule & s
    joined = place.withColumn("_inside", F.max(end).over(inside)).alias("p").join(carried.alias("c"), rule).select("p.*", "c._before")
    until = F.greatest("_inside", "_before")
    out = joined.withColumn("covered_until", until).drop("_inside", "_before", "_range", "_row")
    gap = F.date_diff(F.col(start), F.col("covered_until")) - 1
    shared = F.date_diff(F.least(F.col(end), F.col("covered_until")), F.col(start)) + 1
    known = lambda days: F.when(days > 0, days).when(days.isNotNull(), 0)
    return out.withColumns({"gap_days": known(gap), "overlap_days": known(F.when(F.col("covered_until").isNotNull(), shared))}).withColumns(
        {"has_gap": F.coalesce(F.col("gap_days") > 0, F.lit(False)), "has_overlap": F.coalesce(F.col("overlap_days") > 0, F.lit(False))}
    )


def keep_latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Rows holding the largest ``by`` of their key; ties are all kept.  Aggregate plus join, so a hot key splits."""
    newest = df.groupBy(*keys).agg(F.max(by).alias("_newest"))
    return df.join(newest, list(keys)).where(F.col(by) == F.col("_newest")).drop("_newest")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the first one by ``order`` (must be unique in the key to be repeatable)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Attach per-group aggregates to every row by aggregate and join instead of an unbounded window."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), list(keys), "left")


def lag_buckets(interval: int, periods: int) -> list[tuple[int, int]]:
    """``[(far, near), ..]`` day offsets: period i covers ``i*interval`` back to ``(i-1)*interval+1``."""
    return [(i * interval, (i - 1) * interval + 1) for i in range(1, periods + 1)]


def interval_lags(
    df: DataFrame,
    columns: Sequence[str],
    interval: int = 30,
    num_periods: int = 3,
    date_col: str = "date",
    group_cols: Sequence[str] = ("ix", "iy"),
    agg: str = "avg",
    suffix: str = "lag",
    one_row_per_day: bool = False,
) -> DataFrame:
    """Aggregate each column over earlier day ranges of the same group: ``{column}_{suffix}_{far}``.

    Rows are first reduced to one partial aggregate per group and day, so the ordered frame holds at most one row
    per calendar day; the result is joined back to the rows on (group, day).  ``one_row_per_day`` states that the
    rows are unique per group and day already: the frames then run on them directly, with a single shuffle.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    agg = agg.lower()
    if agg not in ("avg", "sum", "min", "max", "count"):
        raise ValueError(f"{agg!r} cannot be combined from daily parts; use avg, sum, min, max or count")
    keys = [*group_cols, date_col]
    parts = []
    for c in columns:
        if agg in ("avg", "sum"):
            parts.append(F.sum(c).alias(f"_s_{c}"))
        if agg in ("avg", "count"):
            parts.append(F.count(c).alias(f"_n_{c}"))
        if agg in ("min", "max"):
            parts.append(aggregate_named(agg)(F.col(c)).alias(f"_s_{c}"))
    if one_row_per_day:
        own = {f"_s_{c}": F.col(c) for c in columns}
        own |= {f"_n_{c}": F.col(c).isNotNull().cast("long") for c in columns}
        daily = df.withColumns(own)
    else:
        daily = df.groupBy(*keys).agg(*parts)
    w = Window.partitionBy(*group_cols).orderBy(F.unix_date(date_col))
    out = {}
    for c in columns:
        for far, near in lag_buckets(interval, num_periods):
            frame = w.rangeBetween(-far, -near)
            if agg == "avg":
                value = F.try_divide(F.sum(f"_s_{c}").over(frame), F.sum(f"_n_{c}").over(frame))
            elif agg == "sum":
                value = F.sum(f"_s_{c}").over(frame)
            elif agg == "count":
                value = F.coalesce(F.sum(f"_n_{c}").over(frame), F.lit(0))
            else:
                value = aggregate_named(agg)(F.col(f"_s_{c}")).over(frame)
            out[f"{c}_{suffix}_{far}"] = value
    lags = daily.withColumns(out)
    if one_row_per_day:
        return lags.select(*df.columns, *out)
    lags = lags.select(*keys, *out)
    return df.join(lags, keys, "left")


def sample_days(df: DataFrame, n: int, seed: int, date: str = "date") -> DataFrame:
    """``n`` distinct days of each month by seeded hash order; adding months never changes the others."""
    draw = F.md5(F.concat_ws(":", F.date_format(date, "yyyy-MM-dd"), F.lit(seed)).cast("binary"))
    w = Window.partitionBy(F.year(date), F.month(date)).orderBy(draw, F.col(date))
    days = df.select(date).distinct()
    return days.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
