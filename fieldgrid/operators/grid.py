"""Regular grids and table forms of the raster operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted


@dataclass(frozen=True)
class GridSpec:
    """``nx`` x ``ny`` square cells of ``res`` degrees from the lower-left corner ``(xmin, ymin)``."""

    xmin: float
    ymin: float
    res: float
    nx: int
    ny: int

    @classmethod
    def from_extent(cls, xmin: float, xmax: float, ymin: float, ymax: float, res: float) -> "GridSpec":
        return cls(xmin, ymin, res, round((xmax - xmin) / res), round((ymax - ymin) / res))

    def x(self, ix: Column) -> Column:
        return F.lit(self.xmin) + (ix + F.lit(0.5)) * F.lit(self.res)

    def y(self, iy: Column) -> Column:
        return F.lit(self.ymin) + (iy + F.lit(0.5)) * F.lit(self.res)

    @staticmethod
    def _index(steps: Column, at_end: Column, n: int) -> Column:
        """Number of the line ``steps`` cells from the first edge; NaN, infinite and far values are outside."""
        inside = (steps >= 0) & (steps < n)  # NaN is larger than any number
        return F.when(at_end, F.lit(n - 1)).when(inside, F.floor(F.when(inside, steps)).cast("int"))

    def ix(self, x: Column) -> Column:
        """Columns count from the west; a point on a line between two belongs to the eastern one."""
        return self._index((x - F.lit(self.xmin)) / F.lit(self.res), x == F.lit(self.xmin + self.res * self.nx), self.nx)

    def iy(self, y: Column) -> Column:
        """Rows are found from the north, so a point on a line between two belongs to the southern one."""
        top = self.ymin + self.res * self.ny
        return F.lit(self.ny - 1) - self._index((F.lit(top) - y) / F.lit(self.res), y == F.lit(self.ymin), self.ny)

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells as ``ix, iy, x, y``, generated on the executors."""
        ids = spark.range(self.nx * self.ny)
        ids = ids.select((F.col("id") % self.nx).cast("int").alias("ix"), F.floor(F.col("id") / self.nx).cast("int").alias("iy"))
        return self.with_centres(ids)

    def with_centres(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"x": self.x(F.col("ix")), "y": self.y(F.col("iy"))})

    def snap(self, df: DataFrame, x: str = "longitude", y: str = "latitude") -> DataFrame:
        """Add the cell of each point; both indexes are NULL outside the grid."""
        ix, iy = self.ix(F.col(x)), self.iy(F.col(y))
        inside = ix.isNotNull() & iy.isNotNull()
        return df.withColumns({"ix": F.when(inside, ix), "iy": F.when(inside, iy)})


def crop(df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, strict: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """Bounding-box filter, as four range predicates that reach the parquet scan."""
    cx, cy = F.col(x), F.col(y)
    if strict:
        return df.where((cx > xmin) & (cx < xmax) & (cy > ymin) & (cy < ymax))
    return df.where((cx >= xmin) & (cx <= xmax) & (cy >= ymin) & (cy <= ymax))


def with_dates(cells: DataFrame, dates: DataFrame, date: str = "date") -> DataFrame:
    """Every cell on every date.  The calendar travels as one array value, so there is no cross join."""
    calendar = dates.select(F.sort_array(F.collect_set(date))).scalar()
    return cells.withColumn(date, F.explode(calendar))


def _kernel(distance: Column, method: str) -> Column:
    d = F.abs(distance)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - d)
    inner = (4 - 6 * F.pow(d, 2) + 3 * F.pow(d, 3)) / 6
    return F.when(d < 1, inner).when(d < 2, F.pow(2 - d, 3) / 6).otherwise(F.lit(0.0))


def _taps(spark: SparkSession, n_dst: int, dst_min: float, dst_res: float, src_min: float, src_res: float, n_src: int, method: str, src: str, dst: str) -> DataFrame:
    """One axis of a kernel: ``(dst index, src index, weight)``; a handful of rows per grid line.

    Where the target is coarser the kernel is widened by the ratio of the resolutions, so every source cell counts.
    """
    at = (F.lit(dst_min) + (F.col("id") + F.lit(0.5)) * F.lit(dst_res) - F.lit(src_min)) / F.lit(src_res) - F.lit(0.5)
    if method == "near":
        lines = spark.range(n_dst).select(F.col("id").cast("int").alias(dst), F.floor(at + F.lit(0.5)).cast("int").alias("i"))
        taps = lines.select(dst, F.struct("i", F.lit(1.0).alias("w")).alias("tap"))
    elif method in ("bilinear", "cubicspline"):
        wider = max(1.0, dst_res / src_res)
        reach = wider * (1 if method == "bilinear" else 2)
        lines = spark.range(n_dst).select(F.col("id").cast("int").alias(dst), at.alias("at"))
        near = F.sequence(F.ceil(F.col("at") - F.lit(reach)).cast("int"), F.floor(F.col("at") + F.lit(reach)).cast("int"))
        weight = _kernel((F.col("i") - F.col("at")) / F.lit(wider), method)
        taps = lines.select(dst, "at", F.explode(near).alias("i")).select(dst, F.struct("i", weight.alias("w")).alias("tap"))
    else:
        raise ValueError(f"unknown resampling method {method!r}")
    return taps.select(dst, F.col("tap.i").alias(src), F.col("tap.w").alias("w")).where(
        (F.col(src) >= 0) & (F.col(src) < n_src) & (F.col("w") > 0)
    )


def resample(
    df: DataFrame,
    src: GridSpec,
    dst: GridSpec,
    columns: Sequence[str],
    method: str = "cubicspline",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Resample ``columns`` from grid ``src`` to grid ``dst``; weights are renormalised over present values.

    The kernel is separable, so the x and y directions are two small passes, each with at most 4 taps when the target
    is finer, and 4 times the ratio of the resolutions when it is coarser.  Numerator and denominator are carried through both, which keeps the renormalisation exact.
    """
    spark = df.sparkSession
    keys = list(keys)
    tx = _taps(spark, dst.nx, dst.xmin, dst.res, src.xmin, src.res, src.nx, method, "ix", "_tx")
    ty = _taps(spark, dst.ny, dst.ymin, dst.res, src.ymin, src.res, src.ny, method, "iy", "_ty")
    across = df.join(tx, "ix").groupBy(*keys, "_tx", "iy").agg(
        *[F.sum(quoted(c) * F.col("w")).alias(f"_n{i}") for i, c in enumerate(columns)],
        *[F.sum(F.when(quoted(c).isNotNull(), F.col("w"))).alias(f"_d{i}") for i, c in enumerate(columns)],
    )
    both = across.join(ty, "iy").groupBy(*keys, "_tx", "_ty").agg(
        *[
            F.try_divide(F.sum(F.col(f"_n{i}") * F.col("w")), F.sum(F.col(f"_d{i}") * F.col("w"))).alias(c)
            for i, c in enumerate(columns)
        ]
    )
    return both.withColumnsRenamed({"_tx": "ix", "_ty": "iy"})


def regrid(
    df: DataFrame,
    src: GridSpec,
    dst: GridSpec,
    columns: Sequence[str],
    method: str = "cubicspline",
    keys: Sequence[str] = (),
    fill_na: bool = False,
) -> DataFrame:
    """A layer on another grid: optional 3x3 gap fill on the source grid, then :func:`resample` up or down.

    With ``fill_na``, cells that ``df`` lacks count as gaps like those that are NULL; ``keys`` values that occur get
    all cells.  The target grid's extent crops the result.
    """
    if fill_na:
        cells = src.cells(df.sparkSession).select("ix", "iy")
        if keys:
            number = F.explode(F.expr(f"sequence(0, {src.nx * src.ny - 1})"))  # one source grid for each layer
            cells = df.select(*keys).distinct().withColumn("_cell", number)
            cells = cells.select(*keys, F.expr(f"_cell % {src.nx}").alias("ix"), F.expr(f"cast(_cell div {src.nx} as int)").alias("iy"))
        filled = cells.join(df.select(*keys, "ix", "iy", *[quoted(c) for c in columns]), [*keys, "ix", "iy"], "left")
        for c in columns:
            filled = focal_fill(filled, c, keys)
        df = filled
    return resample(df, src, dst, columns, method, keys)


def resample_near(df: DataFrame, src: GridSpec, dst: GridSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-cell resampling of any column type: each target centre takes the source cell it falls in."""
    spark = df.sparkSession
    tx = _taps(spark, dst.nx, dst.xmin, dst.res, src.xmin, src.res, src.nx, "near", "ix", "_tx").drop("w")
    ty = _taps(spark, dst.ny, dst.ymin, dst.res, src.ymin, src.res, src.ny, "near", "iy", "_ty").drop("w")
    values = [c for c in df.columns if c not in ("ix", "iy", *keys)]
    return df.join(tx, "ix").join(ty, "iy").select(
        *keys, F.col("_tx").alias("ix"), F.col("_ty").alias("iy"), *[quoted(c) for c in values]
    )


def resample_mode(df: DataFrame, src: GridSpec, dst: GridSpec, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Dominant class of the fine cells whose centre falls in each coarse cell; lowest class on ties."""
    placed = df.where(quoted(column).isNotNull()).select(
        *keys,
        dst.ix(src.x(F.col("ix"))).alias("ix"),
        dst.iy(src.y(F.col("iy"))).alias("iy"),
        quoted(column).alias(column),
    )
    return most_frequent(placed.where(F.col("ix").isNotNull() & F.col("iy").isNotNull()), [*keys, "ix", "iy"], column)


def most_frequent(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Statistical mode per group in two hash aggregations; lowest value on ties."""
    counts = df.where(quoted(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column))).alias(column))


def dominant_band(bands: Sequence[str]) -> Column:
    """1-based number of the band with the largest value; first on ties, NULL bands ignored."""
    values = F.array(*[quoted(b) for b in bands])
    return F.array_position(values, F.array_max(values)).cast("int")


def focal_fill(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Fill NULL cells with the mean of their present 3x3 neighbours; other cells are untouched."""
    keys = list(keys)
    near = [
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx in (-1, 0, 1)
        for dy in (-1, 0, 1)
        if (dx, dy) != (0, 0)
    ]
    holes = df.where(quoted(column).isNull()).select(*keys, "ix", "iy")
    asks = holes.withColumn("_o", F.explode(F.array(*near))).select(
        *keys,
        F.col("ix").alias("_hx"),
        F.col("iy").alias("_hy"),
        (F.col("ix") + F.col("_o.dx")).alias("ix"),
        (F.col("iy") + F.col("_o.dy")).alias("iy"),
    )
    donors = df.where(quoted(column).isNotNull()).select(*keys, "ix", "iy", quoted(column).alias("_v"))
    filled = asks.join(donors, [*keys, "ix", "iy"]).groupBy(*keys, F.col("_hx").alias("ix"), F.col("_hy").alias("iy")).agg(
        F.avg("_v").alias("_focal")
    )
    out = df.join(filled, [*keys, "ix", "iy"], "left").withColumn(column, F.coalesce(quoted(column), F.col("_focal")))
    return out.drop("_focal").select(*[quoted(c) for c in df.columns])


def grid_points(
    df: DataFrame,
    src: GridSpec,
    dst: GridSpec,
    value: str,
    x: str = "x",
    y: str = "y",
    method: str = "cubicspline",
    fill_na: bool = True,
) -> DataFrame:
    """Irregular points to a regular grid: cell means, optional 3x3 gap fill, then resampling to ``dst``."""
    missing = [c for c in (x, y, value) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cells = src.snap(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y).where(F.col("ix").isNotNull())
    means = cells.groupBy("ix", "iy").agg(F.avg(quoted(value)).alias(value))
    if fill_na:
        means = src.cells(df.sparkSession).select("ix", "iy").join(means, ["ix", "iy"], "left")
        means = focal_fill(means, value).where(quoted(value).isNotNull())
    return resample(means, src, dst, [value], method)


def box_tiles(boxes: DataFrame, step: float = 4.0, least: float = 2.0, pad: float = 2.01) -> DataFrame:
    """Split ``xmin, xmax, ymin, ymax`` boxes in rolling tiles of ``step`` degrees.

    A last strip of at most ``least`` degrees is widened to ``pad`` degrees.
    """

    def cuts(low: str, high: str) -> Column:
        lo, hi = F.col(low), F.col(high)
        n = F.floor((hi - lo) / F.lit(step)).cast("int")
        marks = F.transform(F.sequence(F.lit(0), n), lambda i: lo + i * F.lit(step))
        marks = F.when(F.element_at(marks, -1) < hi, F.array_append(marks, hi)).otherwise(marks)
        return marks

    def spans(marks: Column) -> Column:
        last = F.size(marks) - 2
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                F.get(marks, i).alias("lo"),
                F.when(
                    (i == last) & (F.get(marks, i + 1) - F.get(marks, i) <= F.lit(least)), F.get(marks, i) + F.lit(pad)
                )
                .otherwise(F.get(marks, i + 1))
                .alias("hi"),
            ),
        )

    usable = boxes.where((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")))
    out = usable.withColumn("_xs", spans(cuts("xmin", "xmax"))).withColumn("_ys", spans(cuts("ymin", "ymax")))
    out = out.withColumn("_x", F.explode("_xs")).withColumn("_y", F.explode("_ys"))
    rest = [c for c in boxes.columns if c not in ("xmin", "xmax", "ymin", "ymax")]
    return out.select(
        *rest,
        F.col("_x.lo").alias("x_lo"),
        F.col("_x.hi").alias("x_hi"),
        F.col("_y.lo").alias("y_lo"),
        F.col("_y.hi").alias("y_hi"),
    )
