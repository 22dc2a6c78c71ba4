"""Stored datasets that follow the content of their source, period by period.

Beside the data lies a numbered manifest: for every period the number of source rows, an order-free fingerprint of
them, and the folder its result is in.  A run compares fingerprints, builds the periods that are new or changed into a
folder of their own, and writes the next manifest as its last step.  Readers take the highest finished manifest, so a
run that dies at any point leaves the dataset as it was, and nothing lists or opens the files of unchanged periods.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DONE = "_SUCCESS"


def fingerprints(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n, sum, xor``: rows of each period and two sums of their 64-bit hashes that no order changes.

    NULL and NaN have hashes of their own; repeated rows change the count and the sum.
    """
    h = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull().alias("a"), F.col(f"`{c}`").alias("b")) for c in source.columns])
    return source.withColumn("_h", h).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor("_h").alias("xor")
    )


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def latest_manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and content of the highest finished manifest; 0 and nothing where there is none."""
    at, fs = _files(spark, f"{path}/manifests")
    if not fs.exists(at):
        return 0, None
    numbers = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), _DONE)
        if name.isdigit() and fs.exists(done):
            numbers.append(int(name))
    if not numbers:
        return 0, None
    return max(numbers), spark.read.parquet(f"{path}/manifests/{max(numbers):08d}")


def refresh(
    source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str]
) -> tuple[DataFrame, int]:
    """Bring the dataset under ``path`` up to date and return it with the number of periods that were built.

    ``build`` turns source rows into result rows; it must keep ``keys`` and work period by period.  Periods that the
    source no longer has leave the dataset.  Manifests and folders of earlier runs stay for readers that still use them.
    """
    spark, keys = source.sparkSession, list(keys)
    number, known = latest_manifest(spark, path)
    now = fingerprints(source, keys)
    if known is None:
        marked = now.withColumn("_folder", F.lit(None).cast("string"))
    else:
        old = known.select(*keys, F.col("n").alias("_n"), F.col("sum").alias("_sum"), F.col("xor").alias("_xor"), "folder")
        rule = F.lit(True)
        for k in keys:
            rule = rule & F.col(f"now.{k}").eqNullSafe(F.col(f"old.{k}"))
        same = (F.col("n") == F.col("_n")) & (F.col("sum") == F.col("_sum")) & (F.col("xor") == F.col("_xor"))
        joined = now.alias("now").join(old.alias("old"), rule, "left")
        marked = joined.select("now.*", F.when(same, F.col("folder")).alias("_folder"))
    folder = f"{path}/data/{uuid.uuid4().hex}"
    next_ = marked.select(*keys, "n", "sum", "xor", F.coalesce("_folder", F.lit(folder)).alias("folder"))
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    next_.coalesce(1).write.parquet(staged)  # one row a period; from here on it does not change
    next_ = spark.read.schema(next_.schema).parquet(staged)
    todo = next_.where(F.col("folder") == folder).select(*keys)
    changed = todo.count()
    gone = known is not None and known.count() != next_.count()
    if changed:
        rule = F.lit(True)
        for k in keys:
            rule = rule & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
        rows = source.alias("s").join(F.broadcast(todo.alias("t")), rule, "left_semi")
        build(rows).write.option("compression", "gzip").partitionBy(*keys).parquet(folder)
    if changed or gone or known is None:
        next_.coalesce(1).write.parquet(f"{path}/manifests/{number + 1:08d}")
    return stored(spark, path, build(source), keys), changed


def stored(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dataset as the latest manifest has it; ``like`` gives the columns.  Only its folders are listed."""
    _, known = latest_manifest(spark, path)
    out = None
    for r in ([] if known is None else known.groupBy("folder").agg(F.collect_list(F.struct(*keys)).alias("k")).collect()):
        listed = known.where(F.col("folder") == r["folder"]).select(*keys)
        rows = spark.read.schema(like.schema).parquet(r["folder"]).alias("s")
        rule = F.lit(True)
        for k in keys:
            rule = rule & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
        part = rows.join(F.broadcast(listed.alias("t")), rule, "left_semi").select(*like.columns)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else like.limit(0)
