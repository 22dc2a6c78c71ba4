"""Dataset checks: readable files, schemas, coverage, row counts and null rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import any_missing
from ..functions.columns import quoted


def file_row_counts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows per data file, from the files' own metadata column; no data column is read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def unreadable_files(listed: DataFrame, counts: DataFrame, file: str = "file") -> DataFrame:
    """Listed files that hold no readable row."""
    return listed.join(counts.where(F.col("rows") > 0), file, "left_anti")


def same_schema(frames: Sequence[DataFrame]) -> bool:
    """True when all frames have the same column names and types."""
    kinds = {tuple((f.name, f.dataType.simpleString()) for f in df.schema) for df in frames}
    return len(kinds) <= 1


def missing_dates(df: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Days inside the covered range (of each key) that no row has."""
    bounds = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b")).where(F.col("_a").isNotNull())
    days = bounds.select(*keys, F.explode(F.sequence("_a", "_b")).alias(date))
    return days.join(df.select(*keys, date).distinct(), [*keys, date], "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def coverage_by(df: DataFrame, key: str, unit: Sequence[str]) -> DataFrame:
    """Rows and distinct units per key, for even-coverage checks."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*unit).alias("units"))


def is_even(df: DataFrame, key: str) -> DataFrame:
    """One row: number of different group sizes, and whether all groups are equally large."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_distinct("n").alias("sizes")).withColumn("even", F.col("sizes") == 1)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def missing_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with a flag per column: does it hold any NULL?"""
    return df.agg(*any_missing(columns or df.columns))


def assert_nulls_only_in(df: DataFrame, pattern: str) -> DataFrame:
    """Pass rows through; fail the job on a NULL in a column whose name does not contain ``pattern``."""
    for c in df.columns:
        if pattern not in c:
            checked = F.when(quoted(c).isNotNull(), quoted(c)).otherwise(F.raise_error(F.lit(f"NULL in {c}")).cast(df.schema[c].dataType))
            df = df.withColumn(c, checked)
    return df
