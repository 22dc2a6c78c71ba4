"""Checks of user functions per group (ids X1, X2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators.groups import aggregate_groups, map_cogroups, map_groups, summed
from . import adapters as a
from .registry import query


def slope():
    """Least-squares slope over days, from sums that add up over parts of a group."""

    def partial(rows: pa.Table) -> pa.Table:
        known = rows.filter(pc.is_valid(rows.column("v")))
        x, y = (known.column(c).to_numpy().astype(np.float64) for c in ("day", "v"))
        return pa.table({"n": [float(len(x))], "x": [x.sum()], "y": [y.sum()], "xx": [(x * x).sum()], "xy": [(x * y).sum()]})

    def finish(state: pa.Table) -> pa.Table:
        n, x, y, xx, xy = (state.column(c)[0].as_py() for c in ("n", "x", "y", "xx", "xy"))
        across = n * xx - x * x
        return pa.table({"slope": pa.array([(n * xy - x * y) / across if n > 1 and across > 0 else None], pa.float64()), "n": pa.array([int(n)], pa.int64())})

    return summed("n double, x double, y double, xx double, xy double", "slope double, n long", partial, finish)


@query(
    "X01_slope_by_parts",
    "SELECT ix, iy, CASE WHEN count(temperature) > 1 THEN regr_slope(temperature, date_diff('day', DATE '1995-01-01', date)) END AS slope, count(temperature) AS n FROM daily GROUP BY ix, iy",
    "slope",
)
def _(spark, d):
    """A user aggregate whose states merge: a large cell is worked on by every task that reads it."""
    days = a.daily(spark, d).select("ix", "iy", F.date_diff("date", F.lit("1995-01-01").cast("date")).alias("day"), F.col("temperature").alias("v"))
    return aggregate_groups(days, ["ix", "iy"], slope())


def runs(rows: pa.Table) -> pa.Table:
    """Runs of days that follow each other."""
    day = rows.column("day").to_numpy()
    first = np.flatnonzero(np.append(True, np.diff(day) != 1))[: len(day)]
    return pa.table({"first_day": day[first].astype(np.int32), "days": np.diff(np.append(first, len(day))).astype(np.int32)})


@query(
    "X02_runs_per_cell",
    """SELECT ix, iy, CAST(min(day) AS INT) AS first_day, CAST(count(*) AS INT) AS days FROM (
      SELECT *, day - row_number() OVER (PARTITION BY ix, iy ORDER BY day) AS island FROM (SELECT ix, iy, date_diff('day', DATE '1995-01-01', date) AS day FROM daily)) GROUP BY ix, iy, island""",
)
def _(spark, d):
    """A user function that walks a cell's days in order."""
    days = a.daily(spark, d).select("ix", "iy", F.date_diff("date", F.lit("1995-01-01").cast("date")).alias("day"))
    return map_groups(days, ["ix", "iy"], runs, "first_day int, days int", ["day"])


def last_before(events: pa.Table, days: pa.Table) -> pa.Table:
    """Of each event, the value of the latest day that is not after it."""
    days = days.sort_by("day")
    at = np.searchsorted(days.column("day").to_numpy(), events.column("day").to_numpy(), side="right") - 1
    found = days.column("v").combine_chunks().take(pa.array(np.maximum(at, 0))) if days.num_rows else pa.nulls(events.num_rows, pa.float64())
    value = pc.if_else(pa.array(at >= 0), found, pa.scalar(None, pa.float64()))
    return pa.table({"outbreak_id": events.column("outbreak_id"), "temperature": value})


@query(
    "X02_cogrouped_events",
    """SELECT o.ix, o.iy, o.outbreak_id, arg_max(w.temperature, w.date) AS temperature FROM outbreaks o LEFT JOIN daily w ON w.ix = o.ix AND w.iy = o.iy AND w.date <= o.start_date GROUP BY 1, 2, 3""",
    "temperature",
)
def _(spark, d):
    """A user function of two tables: a cell's events beside its days."""
    day = lambda c: F.date_diff(c, F.lit("1995-01-01").cast("date")).alias("day")
    events = a.grid_spec(spark, d).snap(a.outbreaks(spark, d)).where("ix IS NOT NULL").select("ix", "iy", "outbreak_id", day("start_date"))
    days = a.daily(spark, d).select("ix", "iy", day("date"), F.col("temperature").alias("v"))
    return map_cogroups(events, days, ["ix", "iy"], last_before, "outbreak_id long, temperature double")
