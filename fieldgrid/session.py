"""Session helpers: a tuned local builder and the checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that every plan in this package is written for.  They are Spark's own run-time settings, so they
# can equally be given to spark-submit.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, app: str = "fieldgrid", memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a scratch folder; on a cluster executors could not read one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="fieldgrid-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so it survives executor loss and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """Materialise a lookup table, measure it, and mark it for broadcast only when it is within ``limit``.

    The measure is the number of rows, or the sum of ``weight`` when rows hold arrays.  Beyond the limit the caller's
    equi join shuffles, and adaptive execution splits its skewed partitions.
    """
    stored = cut(df)
    size = stored.count() if weight is None else stored.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(stored) if size <= limit else stored


# Calendar tables hold dates x intervals x days.  Two million rows of dates and small integers are about 50 MB.
MAX_CALENDAR_ROWS = 2_000_000


def calendar_side(df: DataFrame) -> DataFrame:
    """A date table for joining: computed once and broadcast when its counted size allows.

    Its estimate is useless to the planner (dates are often a distinct over a huge table), and a shuffle by date
    would move the data side for nothing.
    """
    return broadcast_if_small(df, MAX_CALENDAR_ROWS)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Place rows by ``columns`` on the full number of shuffle partitions.

    For small tables that fan out next: with an explicit number, adaptive execution does not merge the partitions
    by their present size, which says nothing about the rows they are about to produce.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


class Stored:
    """Parquet tables of one iterative job in the shared folder; each is dropped when its successor is there.

    A table is read with the schema it was written from, so an empty one is a table, too.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, append: bool = False) -> DataFrame:
        df.write.mode("append" if append else "errorifexists").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
