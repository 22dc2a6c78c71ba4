"""Date expressions shared by the plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_date_parts(df: DataFrame, date: str = "date", parts: Sequence[str] = ("doy", "month", "year")) -> DataFrame:
    """Add integer calendar parts of ``date``."""
    build = {"doy": F.dayofyear, "month": F.month, "year": F.year, "day": F.dayofmonth}
    return df.withColumns({p: build[p](F.col(date)).cast("int") for p in parts})


def whole_months(start: Column, end: Column) -> Column:
    """Completed months between two dates."""
    return F.floor(F.months_between(end, start)).cast("int")


def years_between(start: Column, end: Column) -> Column:
    """Elapsed years of 365.25 days."""
    return F.date_diff(end, start) / F.lit(365.25)


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def date_of_year_day(text: Column) -> Column:
    """Parse ``yyyyDDD``."""
    return F.to_date(text, "yyyyDDD")


def spine(spark: SparkSession, start: str, end: str, step: str = "1 day", name: str = "date") -> DataFrame:
    """One row per step from ``start`` to ``end`` inclusive."""
    return spark.sql(
        f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL {step})) AS {name}"
    )


def expand_range(df: DataFrame, start: str, end: str, name: str = "date") -> DataFrame:
    """Repeat each row once per day of ``[start, end]``; rows with ``end < start`` or a NULL bound vanish."""
    return df.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(F.col(start), F.col(end))))


def interval_table(spark: SparkSession, breaks: Sequence[int]) -> DataFrame:
    """Adjacent pairs of a breaks vector as ``(lo, hi)`` rows."""
    if len(breaks) < 2:
        raise ValueError("breaks needs at least two values")
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(breaks, breaks[1:])], "lo int, hi int")
