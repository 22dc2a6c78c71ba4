"""What the operators of this package share: session preparation, tables, stored intermediate results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import cut, ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is not installed, and set the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, known) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine that has the files installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application: visible to the driver and every executor."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


__all__ = ["cut", "prepare", "shared_folder", "table", "vocabulary"]
