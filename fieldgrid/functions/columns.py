"""Column verbs: choosing columns by name, renaming, casting, recoding, null rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A standard deviation below this share of the mean is taken as zero: summation order alone can leave a constant series
# with one of about 1e-16 of its value.  A series around zero has none of that error, so its deviation counts as it is.
ZERO_SD = 1e-12


def columns_matching(
    df: DataFrame,
    pattern: str | None = None,
    *,
    prefix: str | None = None,
    suffix: str | None = None,
    contains: str | None = None,
    without: str | None = None,
) -> list[str]:
    """Column names that satisfy every given rule, in schema order; ``without`` removes names containing it."""
    keep = []
    for name in df.columns:
        if pattern is not None and not re.search(pattern, name):
            continue
        if prefix is not None and not name.startswith(prefix):
            continue
        if suffix is not None and not name.endswith(suffix):
            continue
        if contains is not None and contains not in name:
            continue
        if without is not None and without in name:
            continue
        keep.append(name)
    return keep


def quoted(name: str) -> Column:
    """A column reference that is safe for names holding dots (``wc2.1_30s_elev``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def relocate(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Move ``first`` to the front and keep the others in order."""
    rest = [c for c in df.columns if c not in set(first)]
    return df.select(*[quoted(c) for c in [*first, *rest]])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def add_suffix(df: DataFrame, columns: Iterable[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def cast_columns(df: DataFrame, columns: Iterable[str], dtype: str, lenient: bool = False) -> DataFrame:
    """Cast several columns at once; ``lenient`` turns unparsable values to NULL instead of failing."""
    chosen = set(columns)
    out = []
    for c in df.columns:
        if c not in chosen:
            out.append(quoted(c))
        else:
            col = quoted(c)
            out.append((col.try_cast(dtype) if lenient else col.cast(dtype)).alias(c))
    return df.select(*out)


def mutate_across(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one column expression to many columns in a single projection."""
    return df.withColumns({c: fn(quoted(c)) for c in columns})


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit ``value`` to ``[low, high]`` and keep NULL as NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def all_present(columns: Iterable[str]) -> Column:
    """TRUE when no column is NULL.  NaN counts as present, which is the SQL meaning of ``IS NOT NULL``."""
    rule = F.lit(True)
    for c in columns:
        rule = rule & quoted(c).isNotNull()
    return rule


def drop_incomplete(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.where(all_present(columns if columns is not None else df.columns))


def split_complete(df: DataFrame, columns: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    rule = all_present(list(columns) if columns is not None else df.columns)
    return df.where(rule), df.where(~rule)


def recode(value: Column, mapping: Mapping, default=None, missing=None) -> Column:
    """Look ``value`` up in a fixed mapping; ``default`` for unlisted values, ``missing`` for NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    if default is not None:
        found = F.coalesce(found, F.lit(default))
    return F.when(value.isNull(), F.lit(missing)).otherwise(found)


def row_sum(columns: Iterable[str]) -> Column:
    """Sum across columns with NULL taken as 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(quoted(c), F.lit(0.0))
    return total


def ratio(numerator: Column, spread: Column, level: Column) -> Column:
    """``numerator / spread`` with NULL where the spread is zero, or zero next to the mean ``level`` of its series."""
    return F.when(F.abs(spread) > ZERO_SD * F.abs(level), numerator / spread)
