"""fieldgrid: gridded space-time features, labels and folds as Spark DataFrame plans.

Conventions used everywhere
---------------------------
* A grid cell is the integer pair ``(ix, iy)``; degrees ``x, y`` are derived from it and never joined on.
* Every public function takes and returns DataFrames.  Some run jobs while the plan is built: lookup tables are
  measured before they are broadcast, and ranks store their ranges.  Nothing is collected except metadata whose
  size does not depend on the data volume (column names, a fixed number of range boundaries, fold ids).
* A side is broadcast by a hint only after it has been measured, or where the calendar bounds it; beyond the limit
  the same join shuffles.
* Groups are pre-aggregated to one row per key (map-side combine) before any window or fan-out join, so a key
  that holds a large share of the rows never lands in a single task as raw rows.
"""

CELL = ("ix", "iy")

__all__ = ["CELL"]
