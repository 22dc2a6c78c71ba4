"""Join shapes on top of Spark's equi joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import drop_incomplete


def join_suffix(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("", "_right"),
) -> DataFrame:
    """Equi join that renames clashing non-key columns with a suffix per side."""
    on = list(on)
    clash = [c for c in left.columns if c in set(right.columns) and c not in set(on)]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(right, on, how)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    names = set(right.columns)
    return [c for c in left.columns if c in names]


def natural_join(frames: Iterable[DataFrame]) -> DataFrame:
    """Inner join of all frames, each on every column name it shares with what is joined so far."""

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        on = shared_columns(a, b)
        if not on:
            raise ValueError("natural join needs at least one shared column")
        return a.join(b, on, "inner")

    return reduce(step, frames)


def natural_join_distinct(frames: Iterable[DataFrame]) -> DataFrame:
    """``SELECT DISTINCT * .. NATURAL JOIN .. WHERE every column IS NOT NULL``.

    Distinct and the null rule are pushed into each input.  The result is the same set, because a natural join
    keeps every column of its inputs, and duplicates cannot multiply in the join.  Where all steps join on the same
    columns, each input is placed by them once, which serves both its distinct and the join.
    """
    frames = [drop_incomplete(f) for f in frames]
    on = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    seen, same = set(frames[0].columns), bool(on)
    for f in frames[1:]:
        same &= seen & set(f.columns) == set(on)
        seen |= set(f.columns)
    return natural_join([f.repartition(*on).distinct() if same else f.distinct() for f in frames])


def union_or_natural(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of one source: stacked when their schemas agree, naturally joined when they differ."""
    kinds = {tuple(sorted((f.name, f.dataType.simpleString()) for f in df.schema)) for df in frames}
    if len(kinds) == 1:
        return reduce(lambda a, b: a.unionByName(b), frames)
    return natural_join(frames)


def join_all(frames: Sequence[DataFrame], on: Sequence[str], how: str = "left") -> DataFrame:
    """Fold a list of frames with one join."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def join_or_zero(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join a sparse table and put 0 where it has no row or no value."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def latest_at_or_before(dates: DataFrame, issues: DataFrame, date: str = "date", issue: str = "base_date") -> DataFrame:
    """As-of table: each distinct date with the latest issue date not after it; dates before any issue vanish.

    Both inputs are reduced to distinct calendar days first, so the ordered pass runs over a calendar, whatever
    the number of rows behind it.
    """
    wanted = dates.select(F.col(date).alias("_day"), F.lit(True).alias("_wanted")).distinct()
    issued = issues.select(F.col(issue).alias("_day"), F.col(issue).alias("_issue")).distinct()
    days = wanted.unionByName(issued, allowMissingColumns=True)
    days = days.groupBy("_day").agg(F.max("_wanted").alias("_wanted"), F.max("_issue").alias("_issue"))
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        days.withColumn(issue, F.max("_issue").over(upto))
        .where(F.col("_wanted") & F.col(issue).isNotNull())
        .select(F.col("_day").alias(date), issue)
    )


def previous_available(dates: DataFrame, ceilings: Sequence[int], date: str = "date") -> DataFrame:
    """For each distinct date and offset ``l``, the latest other date strictly before ``date - l`` days.

    Columns ``before_<l>``; NULL when no date is early enough.
    """
    days = dates.select(date).distinct().withColumn("_n", F.unix_date(date))
    w = Window.orderBy("_n")
    return days.withColumns(
        {f"before_{c}": F.max(date).over(w.rangeBetween(Window.unboundedPreceding, -(c + 1))) for c in ceilings}
    ).drop("_n")


def key_coverage(sources: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """How many keys survive joining the sources one after the other: ``(step, source, surviving)``.

    One pass: every source contributes a bit per key, and step ``i`` survives when the lowest ``i`` bits are set.
    Rows that repeat a key set the same bit, so nothing is made distinct before.
    """
    names = list(sources)
    tagged = reduce(
        DataFrame.unionByName,
        [sources[n].select(*keys).withColumn("_bit", F.lit(1 << i).cast("long")) for i, n in enumerate(names)],
    )
    masks = tagged.groupBy(*keys).agg(F.bit_or("_bit").alias("_mask")).groupBy("_mask").agg(F.count(F.lit(1)).alias("_n"))
    checks = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(n).alias("source"),
                F.lit((1 << (i + 1)) - 1).cast("long").alias("need"),
            )
            for i, n in enumerate(names)
        ]
    )
    return (
        masks.withColumn("_c", F.explode(checks))
        .groupBy("_c.step", "_c.source")
        .agg(F.sum(F.when(F.col("_mask").bitwiseAND(F.col("_c.need")) == F.col("_c.need"), F.col("_n")).otherwise(0)).alias("surviving"))
    )
