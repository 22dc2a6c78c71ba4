"""Tables as one row a cell, its days packed in arrays.

Sums over day ranges read a cell's own array by position, for many cells at once: doubled strides hold the sums of 1, 2,
4, .. consecutive days from every day on, and a range adds up one stride for each bit of its length.  So a range takes a
handful of additions however long it is, nothing is multiplied by the dates that ask for it, and a NaN, an infinity or
a very large day touches only the ranges that cover it.  Calendars (dates, intervals, months) are small and travel to
every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 64  # cells that are added up together
ROWS = 1 << 17  # output rows that are built together
DAYS_OF_YEAR = 367  # positions 1 to 366
_NEVER = -900_000  # a day number for dates without an issue


def packed(keys: Sequence[str], **parts: tuple[DataFrame, Mapping[str, Column]]) -> DataFrame:
    """One row a key with an array of structs for each part; all parts meet in one shuffle.

    Each part must hold few rows a key (one a day or issue), whatever the data: reduce it first where it may not.
    """
    keys = list(keys)
    rows = None
    for name, (df, columns) in parts.items():
        part = df.select(*keys, F.struct(*[c.alias(n) for n, c in columns.items()]).alias(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy(*keys).agg(*[F.collect_list(name).alias(name) for name in parts])


@dataclass
class Part:
    """One part of some cells: the cell of each entry, and its fields (missing numbers are NaN, see ``there``)."""

    cell: np.ndarray
    fields: dict[str, pa.Array]

    @staticmethod
    def of(column: pa.Array, begin: int, end: int) -> "Part":
        column = column.slice(begin, end - begin)
        edge = column.offsets.to_numpy()
        entries = column.values.slice(edge[0], edge[-1] - edge[0])
        return Part(np.repeat(np.arange(end - begin), np.diff(edge)), {f.name: entries.field(f.name) for f in entries.type})

    def numbers(self, name: str) -> np.ndarray:
        return self.fields[name].to_numpy(zero_copy_only=False)

    def there(self, name: str) -> np.ndarray:
        return self.fields[name].is_valid().to_numpy(zero_copy_only=False)

    def dense(self, place: np.ndarray, places: int, cells: int, weights: np.ndarray | None = None) -> np.ndarray:
        """Sums (or counts) by place and cell."""
        return np.bincount(place * cells + self.cell, weights, places * cells).astype(np.float64).reshape(places, cells)


def stride_sums(days: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of ``length`` rows of ``days`` from ``start`` on, for every range; none is longer than ``days``."""
    out = np.zeros((len(start), days.shape[1]))
    at, size, level = start.copy(), 1, days
    while size <= length.max(initial=0):
        use = np.flatnonzero(length & size)
        out[use] += level[at[use]]
        at[use] += size
        with np.errstate(invalid="ignore"):
            level = level[: max(len(level) - size, 0)] + level[size:]
        size *= 2
    return out


def sums_and_counts(part: Part, names: Sequence[str], place: np.ndarray, places: int, cells: int, start: np.ndarray, length: np.ndarray) -> tuple[dict, dict, np.ndarray]:
    """Range sums and counts of the numbers that are there, by name, and the number of entries in each range."""
    sums, counts = {}, {}
    for name in names:
        known = part.there(name)
        value = np.where(known, part.numbers(name), 0.0)
        sums[name] = stride_sums(part.dense(place, places, cells, value), start, length)
        counts[name] = stride_sums(part.dense(place, places, cells, known.astype(float)), start, length)
    return sums, counts, stride_sums(part.dense(place, places, cells), start, length)


def map_cells(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[T.StructField], work: Callable[[dict[str, Part], int], Iterator[tuple[np.ndarray, list[pa.Array]]]]
) -> DataFrame:
    """Apply ``work`` to ``CELLS`` packed rows at a time.  It yields the cell of every output row and the columns."""
    keys = list(keys)
    parts = [c for c in rows.columns if c not in keys]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CELLS):
                end = min(batch.num_rows, begin + CELLS)
                for cell, values in work({p: Part.of(batch.column(p), begin, end) for p in parts}, end - begin):
                    at = pa.array(cell + begin)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *values], names=[*keys, *[c.name for c in columns]])

    return rows.mapInArrow(task, T.StructType([*[rows.schema[k] for k in keys], *columns]))


def number(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Doubles with nulls; a NaN that is there stays a NaN."""
    return pa.array(values, pa.float64(), mask=~there)


def range_sums(
    rows: DataFrame, at: str, sums: Mapping[str, Column], ranges: DataFrame, first: str, last: str, keys: Sequence[str]
) -> DataFrame:
    """Sums of ``rows`` with ``at`` in ``[first, last]``, for every key that occurs and every distinct row of ``ranges``.

    Rows are added up by key and ``at`` before they are packed.  ``ranges`` is a calendar table; NULLs count as 0.
    """
    keys, names = list(keys), list(sums)
    daily = rows.groupBy(*keys, F.col(at).cast("int").alias("_at")).agg(*[F.sum(c.cast("double")).alias(n) for n, c in sums.items()]).where("_at IS NOT NULL")
    asked, schema = ranges.distinct().toArrow().combine_chunks(), ranges.schema
    start = asked.column(first).to_numpy().astype(np.int64)
    length = np.maximum(asked.column(last).to_numpy().astype(np.int64) - start + 1, 0)
    columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in asked.columns]

    def work(parts: dict[str, Part], cells: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        part = parts["_days"]
        place = part.numbers("_at").astype(np.int64)
        low, high = (place.min(), place.max() + 1) if len(place) else (0, 1)
        begin = np.clip(start, low, high)
        size = np.clip(start + length, begin, high) - begin
        found = [stride_sums(part.dense(place - low, high - low, cells, np.where(part.there(n), part.numbers(n), 0.0)), begin - low, size) for n in names]
        step = max(1, ROWS // cells)
        for a in range(0, len(start), step):
            r, c = (x.ravel() for x in np.indices((min(step, len(start) - a), cells)))
            yield c, [*[x.take(pa.array(r + a)) for x in columns], *[pa.array(f[r + a, c]) for f in found]]

    days = packed(keys, _days=(daily, {"_at": F.col("_at"), **{n: F.col(n) for n in names}}))
    return map_cells(days, keys, [*schema, *[T.StructField(n, T.DoubleType()) for n in names]], work)


@dataclass
class Calendar:
    """Dates and intervals (``date, hi``), each with its segments of whole months.

    Groups are dates x intervals; the segments of a group follow each other from ``group[g]`` on.
    """

    date: np.ndarray
    hi: np.ndarray
    group: np.ndarray
    span: np.ndarray  # of a segment: its number in ``first, length``
    first: np.ndarray
    length: np.ndarray
    lead: np.ndarray  # of a segment: its number in ``issues``, if they are given
    issues: np.ndarray

    @staticmethod
    def of(segments: DataFrame) -> "Calendar":
        """From ``date, hi, first_doy, last_doy, year, month`` and, for forecasts, ``base_date``."""
        issued = "base_date" in segments.columns
        names = ["date", "hi", "first_doy", "last_doy", "year", "month", *(["base_date"] if issued else [])]
        days = lambda c: F.coalesce(F.unix_date(c), F.lit(_NEVER)).alias(c)
        t = segments.select(*[days(c) if c.endswith("date") else F.col(c).cast("int").alias(c) for c in names]).distinct().toPandas()
        t = t.sort_values(["date", "hi", "first_doy"])
        column = {c: t[c].to_numpy(np.int64) for c in names}
        new = np.append(True, (np.diff(column["date"]) != 0) | (np.diff(column["hi"]) != 0))[: len(t)]
        group = np.flatnonzero(new)
        spans, span = np.unique(column["first_doy"] * 1000 + column["last_doy"], return_inverse=True)
        issues, lead = (np.unique(issue_key(column["base_date"], column["year"], column["month"]), return_inverse=True)) if issued else (np.zeros(0, np.int64),) * 2
        first = spans // 1000
        return Calendar(column["date"][group], column["hi"][group], group, span, first, spans % 1000 - first + 1, lead, issues)

    def blocks(self, cells: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Groups, their segments, and where in these each group begins: about ``ROWS`` rows at a time."""
        step = max(1, ROWS // max(cells, 1))
        for a in range(0, len(self.group), step):
            b = min(len(self.group), a + step)
            begin, end = self.group[a], self.group[b] if b < len(self.group) else len(self.span)
            yield slice(a, b), slice(begin, end), self.group[a:b] - begin


def issue_key(base: np.ndarray, year: np.ndarray, month: np.ndarray) -> np.ndarray:
    """Issue date (as a day number) and month ahead in one number."""
    return (base.astype(np.int64) + 1_000_000) * 1_000_000 + year.astype(np.int64) * 12 + month.astype(np.int64)


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return a / b


def interval_means(
    rows: DataFrame, keys: Sequence[str], calendar: Calendar, value_cols: Sequence[str], forecast: bool, recorded: tuple[np.ndarray, np.ndarray] | None
) -> DataFrame:
    """``keys, date, hi`` and for every variable ``v`` the means ``_h_v, _d_v`` (climatology and its deviation), with
    ``forecast`` ``_p_v``, with ``recorded`` ``_r_v``, for every date and interval in which the cell has a climatology.

    ``rows`` holds ``_clim`` (``at`` and two columns a variable), ``_lead`` (``base, year, month`` and one a variable) and
    ``_seen`` (``at, rows`` and ``s_v, n_v``, one entry a day).  ``recorded`` has the first day and the length of every group.
    The forecast is weighted by the climatology's days of each month; a month without it counts for nothing.  A
    recorded mean is NULL when one of its days is, or when there is none.
    """
    value_cols = list(value_cols)
    both = [*value_cols, *[f"{c}_sd" for c in value_cols]]
    kinds = ["h", "d", *("p" if forecast else ""), *("r" if recorded is not None else "")]
    sent = rows.sparkSession.sparkContext.broadcast((calendar, recorded))

    def seen_means(part: Part, cells: int, first: np.ndarray, length: np.ndarray) -> dict:
        if not len(part.cell):
            nothing = np.zeros((len(first), cells))
            return {c: (nothing, nothing > 0) for c in value_cols}
        place = part.numbers("at").astype(np.int64)
        low, high = place.min(), place.max() + 1
        begin = np.clip(first, low, high)
        size = np.clip(first + length, begin, high) - begin
        add = lambda name: stride_sums(part.dense(place - low, high - low, cells, np.where(part.there(name), part.numbers(name), 0.0)), begin - low, size)
        days, out = add("rows"), {}
        for c in value_cols:
            n = add(f"n_{c}")
            out[c] = (_divided(add(f"s_{c}"), n), (n == days) & (n > 0))
        return out

    def work(parts: dict[str, Part], cells: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        cal, spans = sent.value
        clim = parts["_clim"]
        if not len(clim.cell) or not len(cal.group):
            return
        sums, counts, days = sums_and_counts(clim, both, clim.numbers("at").astype(np.int64), DAYS_OF_YEAR, cells, cal.first, cal.length)
        if forecast:
            lead = parts["_lead"]
            key = issue_key(lead.numbers("base"), lead.numbers("year"), lead.numbers("month"))
            at = np.searchsorted(cal.issues, key)
            asked = at < len(cal.issues)
            asked[asked] = cal.issues[at[asked]] == key[asked]
            ahead = {}
            for c in value_cols:
                here = np.flatnonzero(asked & lead.there(c))
                value = lead.numbers(c)
                here = here[np.argsort(value[here], kind="stable")]  # of several the largest, NaN above all
                table = np.zeros((2, len(cal.issues), cells))
                table[0, at[here], lead.cell[here]] = value[here]
                table[1, at[here], lead.cell[here]] = 1.0
                ahead[c] = table
        for groups, segments, begin in cal.blocks(cells):
            span = cal.span[segments]
            add = lambda x: np.add.reduceat(x, begin, axis=0)  # noqa: E731, B023
            weight = days[span]
            g, cell = np.nonzero(add(weight) > 0)
            columns = []
            recorded_here = None if spans is None else seen_means(parts["_seen"], cells, spans[0][groups], spans[1][groups])
            for c in value_cols:
                for name in (c, f"{c}_sd"):
                    n = add(counts[name][span])
                    columns.append(number(_divided(add(sums[name][span]), n)[g, cell], (n > 0)[g, cell]))
                if forecast:
                    value, known = ahead[c][:, cal.lead[segments]]
                    w = weight * known
                    n = add(w)
                    columns.append(number(_divided(add(np.where(w > 0, value, 0.0) * w), n)[g, cell], (n > 0)[g, cell]))
                if recorded_here is not None:
                    value, known = recorded_here[c]
                    columns.append(number(value[g, cell], known[g, cell]))
            date = pa.array(cal.date[groups][g].astype(np.int32)).cast(pa.date32())
            yield cell, [date, pa.array(cal.hi[groups][g].astype(np.int32)), *columns]

    fields = [T.StructField("date", T.DateType()), T.StructField("hi", T.IntegerType())]
    fields += [T.StructField(f"_{k}_{c}", T.DoubleType()) for c in value_cols for k in kinds]
    return map_cells(rows, keys, fields, work)
