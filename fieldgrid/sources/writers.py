"""Sinks: gzip parquet by partition key, and building only what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    mode: str = "overwrite",
    files_per_key: int = 1,
) -> str:
    """Gzip parquet, one directory per key.

    Rows are clustered on the partition key before the write so a task holds few keys and the number of files
    stays near ``keys * files_per_key``.  ``files_per_key`` spreads a key over several tasks, for a date that
    holds a large share of the rows; ``rebalance`` lets adaptive execution split it further.
    """
    if partition_by:
        if files_per_key > 1:
            df = df.withColumn("_spread", F.pmod(F.xxhash64(*[c for c in df.columns if c not in partition_by]), F.lit(files_per_key)))
            df = df.repartition(*partition_by, "_spread").drop("_spread")
        else:
            df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode).option("compression", "gzip").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def existing_keys(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """Partition keys stored under ``path``, with the given types; ``None`` when nothing is there.

    A key counts as stored when every file listed under it opens and holds rows, so a damaged or half-written period
    is built again.  Only footers are read.  Only a missing path means that nothing is stored; other errors are raised.
    """
    names = schema.names
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not set(names) <= set(files.columns):  # no period was ever finished
        return None
    base = F.element_at(F.split("_path", "/"), -1).alias("_file")
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    listed = files.select(*typed, F.col("path").alias("_path")).select(*names, base)
    opened = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    opened = opened.select(*names, F.col("_metadata.file_path").alias("_path")).select(*names, base).distinct()
    damaged = listed.join(opened, [*names, "_file"], "left_anti").select(*names).distinct()
    return opened.select(*names).distinct().join(damaged, names, "left_anti")


def missing_keys(
    wanted: DataFrame, path: str, keys: Sequence[str], refresh: Column | None = None, overwrite: bool = False
) -> DataFrame:
    """Wanted keys that still have to be built: not stored yet, or matched by ``refresh`` (the current period)."""
    wanted = wanted.select(*keys).distinct()
    stored = None if overwrite else existing_keys(wanted.sparkSession, path, wanted.schema)
    if stored is None:
        return wanted
    if refresh is not None:
        stored = stored.where(~F.coalesce(refresh, F.lit(False)))
    return wanted.join(stored, list(keys), "left_anti")


def materialize(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    overwrite: bool = False,
    refresh: Column | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Write the partitions of ``df`` that are not stored yet, and return the whole stored dataset.

    ``refresh`` is a rule on the keys naming the periods that are always rebuilt.  Stored partitions outside the
    rebuilt keys are not touched (dynamic partition overwrite).  ``wanted`` names the keys to have (say, the model
    dates); without it they are read from ``df``, one pass more.  The semi join on the missing keys is pushed below
    aggregates on those keys, so stored periods are not computed again.
    """
    todo = missing_keys(df if wanted is None else wanted, path, keys, refresh, overwrite)
    write_parquet(df.join(todo, list(keys), "left_semi"), path, keys)
    return df.sparkSession.read.schema(_stored_schema(df, keys)).parquet(path)


def _stored_schema(df: DataFrame, keys: Sequence[str]) -> StructType:
    names = [c for c in df.columns if c not in keys] + list(keys)
    return StructType([df.schema[n] for n in names])
