"""Aggregate builders with explicit missing-value rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import quoted

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "avg": F.avg,
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "sd": F.stddev_samp,
    "mode": lambda c: F.mode(c, True),
}


def aggregate_named(name: str) -> Callable[[Column], Column]:
    """Look an aggregate up by (case-insensitive) name."""
    try:
        return AGGREGATES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown aggregate {name!r}; known: {', '.join(sorted(AGGREGATES))}") from None


def mean(value: Column, na_rm: bool = True) -> Column:
    """Mean; with ``na_rm=False`` a single NULL makes the whole group NULL."""
    if na_rm:
        return F.avg(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def total(value: Column) -> Column:
    """Sum of the present values; 0 when there are none."""
    return F.coalesce(F.sum(value), F.lit(0))


def means(columns: Iterable[str], na_rm: bool = True) -> list[Column]:
    return [mean(quoted(c), na_rm).alias(c) for c in columns]


def means_and_sds(columns: Iterable[str]) -> list[Column]:
    """Mean under the column's own name and sample deviation as ``<name>_sd``, for one pass over the data."""
    out = []
    for c in columns:
        out += [F.avg(quoted(c)).alias(c), F.stddev_samp(quoted(c)).alias(f"{c}_sd")]
    return out


def five_numbers(column: str, na_rm: bool = True) -> list[Column]:
    """Mean, sample deviation, minimum, maximum and range; with ``na_rm=False`` one NULL makes all of them NULL."""
    c = quoted(column)
    stats = {
        "mean": F.avg(c),
        "sd": F.stddev_samp(c),
        "min": F.min(c),
        "max": F.max(c),
        "range": F.max(c) - F.min(c),
    }
    whole = F.count(c) == F.count(F.lit(1))
    return [(v if na_rm else F.when(whole, v)).alias(k) for k, v in stats.items()]


def weighted_mean(value: Column, weight: Column) -> Column:
    used = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * used), F.sum(used))


def any_missing(columns: Iterable[str]) -> list[Column]:
    return [F.max(quoted(c).isNull()).alias(c) for c in columns]


def global_range(columns: Iterable[str]) -> list[Column]:
    """One minimum and one maximum over several columns."""
    cols = [quoted(c) for c in columns]
    if len(cols) == 1:
        return [F.min(cols[0]).alias("min"), F.max(cols[0]).alias("max")]
    return [
        F.least(*[F.min(c) for c in cols]).alias("min"),
        F.greatest(*[F.max(c) for c in cols]).alias("max"),
    ]


def spec_aggregates(spec: Mapping[str, str | None]) -> tuple[list[str], list[Column]]:
    """Split an aggregation spec into group keys (no function given) and ``<var>_<fn>`` aggregates.

    ``AVG`` and ``SUM`` skip NULLs (``SUM`` of nothing is 0); ``MODE`` takes the lowest value on ties.
    """
    keys = [v for v, fn in spec.items() if not fn]
    out = []
    for var, fn in spec.items():
        if not fn:
            continue
        name = fn.lower()
        label = "avg" if name == "mean" else name
        expr = total(quoted(var)) if name == "sum" else aggregate_named(name)(quoted(var))
        out.append(expr.alias(f"{var}_{label}"))
    return keys, out
