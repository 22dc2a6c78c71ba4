"""Daily outbreak history of one year on a continental 0.1-degree grid; prints the seconds it takes.

    python tools/year_history.py [sf_dir]

Events come from the orders of the test tables, scattered over the extent by hash; cells are thinned by hash to
about the land share of the continent (281,000 cells, 103 million cell-days).
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from fieldgrid.checks import adapters
    from fieldgrid.functions.dates import spine
    from fieldgrid.operators.grid import GridSpec
    from fieldgrid.plans import events
    from fieldgrid.session import ensure_checkpoint_dir, local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, memory="16g", shuffle_partitions=64)
    ensure_checkpoint_dir(spark)
    grid = GridSpec(-18.0, -35.0, 0.1, 700, 730)
    cells = grid.cells(spark).where("pmod(xxhash64(ix, iy), 100) < 55").select("ix", "iy")
    outbreaks = adapters.outbreaks(spark, sf_dir).select(
        "cases",
        "start_date",
        (F.lit(-17.0) + F.pmod(F.xxhash64("outbreak_id"), F.lit(6800)) / 100).alias("longitude"),
        (F.lit(-34.0) + F.pmod(F.xxhash64("outbreak_id", F.lit(1)), F.lit(7100)) / 100).alias("latitude"),
    )
    start = time.perf_counter()
    history = events.outbreak_history(spine(spark, "2000-01-01", "2000-12-31"), outbreaks, grid, cells=cells)
    history.write.format("noop").mode("overwrite").save()
    print(f"{time.perf_counter() - start:.1f} s")


if __name__ == "__main__":
    main()
