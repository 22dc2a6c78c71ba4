"""Model dates."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import spine
from ..operators.windows import sample_days


def model_dates(
    spark: SparkSession,
    start_year: int,
    end_year: int,
    n_per_month: int | None = None,
    seed: int = 123,
    today: Date | None = None,
) -> DataFrame:
    """``n_per_month`` days of each month (all days when ``None``), none after ``today``.

    The draw of a month depends on its days and the seed only, so adding years changes no earlier month.
    """
    if start_year > end_year:
        raise ValueError("start_year must be less than or equal to end_year")
    if n_per_month is not None and n_per_month <= 0:
        raise ValueError("n_per_month must be positive or None")
    days = spine(spark, f"{start_year}-01-01", f"{end_year}-12-31")
    if n_per_month is not None:
        days = sample_days(days, n_per_month, seed)
    limit = F.current_date() if today is None else F.lit(today)
    return days.where(F.col("date") <= limit)
