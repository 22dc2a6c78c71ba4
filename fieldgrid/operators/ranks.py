"""Total orders over the whole data without a single-task sort.

Rows are range-partitioned on the order columns, sorted inside each range and written to the checkpoint folder
with the row's position.  What is left is one offset per range, so ranks and running totals are exact while
no task sees more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered_ranges(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """Add ``_range`` (number of the ordered range) and ``_row`` (0-based position in it) and materialise."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [_as_column(c) for c in order]
    placed = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    placed = placed.withColumn("_place", F.monotonically_increasing_id())
    return cut(placed).select(
        "*",
        F.shiftright("_place", _ROW_BITS).cast("int").alias("_range"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    ).drop("_place")


def row_numbers(df: DataFrame, order: Sequence[str | Column], name: str, ranges: int | None = None) -> DataFrame:
    """Row number 1..n over the total order given by ``order``.

    Where ``order`` names columns, only these are placed in ranges and stored, one row for each value that occurs; rows
    then look their number up, and those that share a value are numbered among themselves.
    """
    if all(isinstance(c, str) for c in order):
        return _looked_up_numbers(df, list(order), name, ranges)
    placed = ordered_ranges(df, order, ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(offsets, "_range")
        .withColumn(name, F.col("_row") + F.col("_offset") + 1)
        .drop("_range", "_row", "_offset")
    )


def _looked_up_numbers(df: DataFrame, order: list[str], name: str, ranges: int | None) -> DataFrame:
    values = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    starts = running_totals(values, order, {"_upto": "_n"}, ranges=ranges)
    starts = starts.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], (F.col("_upto") - F.col("_n")).alias("_before"))
    rule = F.lit(True)
    for i, c in enumerate(order):
        rule = rule & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    found = df.join(starts, rule, "left").drop(*[f"_o{i}" for i in range(len(order))])
    shared = not values.where("_n > 1").isEmpty()
    place = F.row_number().over(Window.partitionBy(*order).orderBy(F.lit(0))) if shared else F.lit(1)
    return found.withColumn(name, (F.col("_before") + place).cast("long")).drop("_before")


def batch_numbers(df: DataFrame, order: Sequence[str | Column], size: int, name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows, numbered from 1."""
    return row_numbers(df, order, "_rn").withColumn(
        name, (F.floor((F.col("_rn") - 1) / size) + 1).cast("long")
    ).drop("_rn")


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str],
    group: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``{new_name: column}`` along ``order`` inside each ``group``.

    ``order`` must be unique inside a group (aggregate to one row per order key first).
    """
    cols = [_as_column(c) for c in order]
    placed = ordered_ranges(df, [*group, *cols], ranges)
    inside = Window.partitionBy("_range", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group) if group else Window.partitionBy()
    earlier = earlier.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("_range", *group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    carried = carried.select(
        "_range", *group, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    out = placed.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    out = out.join(carried, ["_range", *group])
    out = out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_c_{n}") for n in sums})
    return out.drop("_range", "_row", *[f"_i_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles in one row, ``q<prob>`` per probability; NULLs are skipped.

    Values are counted, ordered by ranges and accumulated; each quantile is then the smallest value whose running
    count passes its position.  No task holds all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    steps = running_totals(counts, [column], {"_upto": "_n"})
    total = steps.agg(F.max("_upto")).scalar()
    steps = steps.withColumn("_all", total)
    out = []
    for p in probs:
        at = (F.col("_all") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(column)))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(column)))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(f"q{p}"))
    return steps.agg(*out)
