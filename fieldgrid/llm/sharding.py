"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows are shuffled inside each source by a seeded hash and ranked; the fractional rank ``(rank - 1/2) / rows`` of the
source is their place in the mixture.  Sorting by it and cutting into equal runs gives shards whose row counts are at
most one apart and which all hold the sources in the corpus' proportions.

No window is partitioned by source: ranks come from range partitions, whose number of rows per source is added up, so
a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ordered_ranges
from .common import cut


def _before(window) -> Column:
    return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def interleave(df: DataFrame, key: str, stratum: str, shards: int, seed: int = 17) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0) to narrow rows.

    ``df`` should hold what has to travel only.  Null strata form one stratum of their own; null keys are ordinary
    keys.  Repeated rows are all kept; rows that agree in every column may swap places.  An empty table gives none.
    """
    other = sorted(c for c in df.columns if c not in (key, stratum))
    rows = df.withColumns(
        {
            "_s": F.concat(F.when(F.col(stratum).isNull(), "0").otherwise("1"), F.coalesce(F.col(stratum).cast("string"), F.lit(""))),
            "_h": F.xxhash64(F.lit(seed), F.col(key), *[F.col(c) for c in other]),
        }
    )
    order = ["_h", key, *other]
    placed = ordered_ranges(cut(rows), ["_s", *order])
    counts = placed.groupBy("_range", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_low"))
    by_source = Window.partitionBy("_s")  # one row per range that the source reaches
    counts = counts.select(
        "_range", "_s", (_before(by_source.orderBy("_range")) - F.col("_low")).alias("_shift"), F.sum("_n").over(by_source).alias("_all")
    )
    ranked = placed.join(counts, ["_range", "_s"]).withColumn(
        "_place", (F.col("_row") + F.col("_shift") + F.lit(0.5)) / F.col("_all")
    )
    mixed = ordered_ranges(ranked.drop("_range", "_row", "_shift", "_all"), ["_place", "_s", *order])
    sizes = mixed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(  # one row per range
        "_range", _before(Window.orderBy("_range")).alias("_shift"), F.sum("_n").over(Window.partitionBy()).alias("_all")
    )
    at = mixed.join(F.broadcast(sizes), "_range").withColumn("_at", F.col("_row") + F.col("_shift"))
    shard = F.floor(F.expr(f"_at * {shards} div _all"))
    first = F.expr(f"(cast(shard as bigint) * _all + {shards - 1}) div {shards}")
    out = at.withColumn("shard", shard.cast("int"))
    return out.withColumn("slot", F.col("_at") - first).drop("_s", "_h", "_range", "_row", "_place", "_shift", "_all", "_at")


def shard_documents(documents: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    The text itself never travels: its length and checksum are taken at the scan.  Size is the UTF-8 length (null: 0)
    plus 8.  ``law`` is ``rows``: shard counts differ by one at most, so ``grown_shard`` is null.  Equal texts are no
    unit of this method; they are dealt like other rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = documents.select(
        F.col("doc_id"), F.col("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = interleave(narrow, "doc_id", "source", shards, seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
