"""Wide predictor tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import relocate
from ..operators.joins import join_or_zero, natural_join, natural_join_distinct, shared_columns, union_or_natural
from ..session import calendar_side
from ..sources.validation import assert_nulls_only_in


def assemble_predictors(
    sources: Mapping[str, DataFrame | Sequence[DataFrame]], dates: DataFrame | None = None
) -> DataFrame:
    """All sources of each date joined on their shared columns; distinct rows without any NULL.

    Frames of one source are stacked when their schemas agree and naturally joined when they differ.  Sources with
    a ``date`` column are limited to ``dates`` before any shuffle; all dates are built in one job.
    """
    wanted = None if dates is None else calendar_side(dates.select("date").distinct())
    dynamic, static = [], []
    for parts in sources.values():
        df = union_or_natural([parts] if isinstance(parts, DataFrame) else list(parts))
        if "date" not in df.columns:
            static.append(df)
        else:
            dynamic.append(df if wanted is None else df.join(wanted, "date", "left_semi"))
    # Static layers are joined among themselves first (one row per cell), so the wide daily rows meet them once.
    return natural_join([natural_join_distinct(group) for group in (dynamic, static) if group])


def join_layers(static: Sequence[DataFrame], dynamic: Sequence[DataFrame], nulls_allowed: str = "scaled") -> DataFrame:
    """Left-join static layers by cell and dynamic layers by cell and date onto the first dynamic layer.

    A NULL is an error outside columns whose name contains ``nulls_allowed``.
    """
    base = dynamic[0]
    joined = reduce(lambda a, b: a.join(b, shared_columns(a, b), "left"), [*dynamic[1:], *static], base)
    return assert_nulls_only_in(joined, nulls_allowed)


def attach_response(predictors: DataFrame, response: DataFrame) -> DataFrame:
    """Left join the sparse response; cells without an outbreak get 0 cases."""
    labels = response.select("ix", "iy", "date", "forecast_interval", "cases")
    out = join_or_zero(predictors, labels, ["ix", "iy", "date", "forecast_interval"], ["cases"])
    return relocate(out, ["ix", "iy", "cases", "date", "forecast_interval"])


def keys_by_natural_join(frames: Sequence[DataFrame]) -> DataFrame:
    return natural_join(frames)
