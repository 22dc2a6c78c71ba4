"""Tables stored along a space-filling curve, so that a box of cells and days reads few files and row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15  # of each of three numbers; the key has 45


def curve_key(*numbers: Column, bits: int = BITS) -> Column:
    """Bits of non-negative integers interleaved: rows that are near in all of them are mostly near on the curve.

    Numbers beyond ``bits`` bits are cut to their lower ones, which costs locality, never rows.  NULL counts as 0.
    """
    key = F.lit(0).cast("long")
    for b in range(bits):
        for i, n in enumerate(numbers):
            bit = F.shiftright(F.coalesce(n.cast("long"), F.lit(0)), b).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, b * len(numbers) + i))
    return key


def write_along_curve(
    df: DataFrame, path: str, files: int, x: str = "ix", y: str = "iy", date: str = "date", origin: str = "1990-01-01", row_group_bytes: int = 8 << 20
) -> str:
    """Gzip parquet in ``files`` ranges of the curve through cells and days, each sorted along it.

    The readers' own minimum and maximum of ``x``, ``y`` and ``date`` then leave out most files and row groups for a box;
    nothing has to know about the curve to read it.  Ranges follow the data, so a crowded cell or day is split.
    """
    day = F.greatest(F.date_diff(F.col(date), F.lit(origin).cast("date")), F.lit(0))
    key = curve_key(F.col(x), F.col(y), day)
    placed = df.withColumn("_curve", key).repartitionByRange(files, "_curve", x, y, date).sortWithinPartitions("_curve", x, y, date)
    placed.drop("_curve").write.mode("overwrite").option("compression", "gzip").option("parquet.block.size", row_group_bytes).parquet(path)
    return path
