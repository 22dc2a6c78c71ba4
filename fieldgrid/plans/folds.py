"""Expanding-window outer folds, balanced spatial clusters and leave-one-cluster-out inner folds.

Membership of a row in a fold depends on its date (outer) and its district (inner) only.  The fold tables are
therefore keyed by date and by district; data rows are never copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers, running_totals
from ..session import calendar_side, cut


def outer_folds(spark: SparkSession, start_date: str, end_date: str, horizon: int = 90, step: int = 90) -> DataFrame:
    """``fold_id, train_end, assess_start, assess_end`` with the train end stepping from start to end date."""
    starts = spark.sql(
        f"SELECT posexplode(sequence(DATE'{start_date}', DATE'{end_date}', INTERVAL {step} DAY)) AS (i, train_end)"
    )
    return starts.select(
        (F.col("i") + 1).alias("fold_id"),
        "train_end",
        F.date_add("train_end", 1).alias("assess_start"),
        F.date_add("train_end", horizon).alias("assess_end"),
    )


def outer_assignments(
    data: DataFrame, start_date: str, end_date: str, horizon: int = 90, step: int = 90, date: str = "date"
) -> DataFrame:
    """``date, fold_id, role``: each distinct date with the folds it trains and the folds it assesses.

    The folds of a date follow from arithmetic on its distance to the start, so there is no range join.
    """
    days = data.select(date).distinct()
    start, end = F.to_date(F.lit(start_date)), F.to_date(F.lit(end_date))
    last = F.floor(F.date_diff(end, start) / step).cast("int") + 1
    gap = F.date_diff(F.col(date), start)
    first_train = F.greatest(F.ceil(gap / F.lit(step)).cast("int") + 1, F.lit(1))
    train = days.withColumn("_a", first_train).where(F.col("_a") <= last).select(
        date, F.explode(F.sequence("_a", last)).alias("fold_id"), F.lit("train").alias("role")
    )
    # Assessed when train_end < date <= train_end + horizon.
    lo = F.greatest(F.ceil((gap - horizon) / F.lit(step)).cast("int") + 1, F.lit(1))
    hi = F.least(F.ceil(gap / F.lit(step)).cast("int"), last)
    assess = days.withColumns({"_a": lo, "_b": hi}).where(F.col("_a") <= F.col("_b")).select(
        date, F.explode(F.sequence("_a", "_b")).alias("fold_id"), F.lit("assess").alias("role")
    )
    return train.unionByName(assess)


def fold_labels(folds: DataFrame, data: DataFrame, date: str = "date") -> DataFrame:
    """Add ``train_range`` and ``assess_range`` to outer folds: first and last day, as text."""
    first = data.agg(F.min(date)).first()[0]
    return folds.withColumns(
        {
            "train_range": F.concat_ws(" ", F.lit(first).cast("date").cast("string"), F.col("train_end").cast("string")),
            "assess_range": F.concat_ws(" ", F.col("assess_start").cast("string"), F.col("assess_end").cast("string")),
        }
    )


_PARTS = 1_000_000  # coordinates are counted in parts of one by this, so sums of clusters are integers
_KEPT_MOVES = 200  # moves that are kept beside the stored clusters before these are written anew


def _squared(x: Column, y: Column, cx: float, cy: float) -> Column:
    return F.pow(x - F.lit(cx), 2) + F.pow(y - F.lit(cy), 2)


def kmeans(
    districts: DataFrame, k: int, seed: int, region_col: str = "region", x: str = "x", y: str = "y"
) -> tuple[DataFrame, list[tuple[float, float]]]:
    """``region, cluster`` and the cluster centres of district centroids, such that no single move improves them.

    The start is ``k`` different points by seeded hash.  Rounds of nearest centre and mean bring it near; then districts
    move one by one: a move out of a cluster of ``a`` into one of ``b`` changes the sum of squares by
    ``b / (b + 1) * to - a / (a - 1) * from``.  In each pass every pair of clusters offers its best move, and those that
    touch no cluster twice are made together, so their changes add up.  The sum falls with every move, so this ends.

    Coordinates are rounded to millionths and added up as integers, and equal moves go by name: the result does not
    depend on partitions.  Fewer than ``k`` different points make as many clusters.
    """
    part = lambda c: F.round(F.col(c) * _PARTS).cast("long")
    points = cut(districts.select(region_col, part(x).alias("_x"), part(y).alias("_y")))
    order = F.min(F.md5(F.concat(F.lit(f"{seed}:"), F.col(region_col).cast("string"))))
    start = points.groupBy("_x", "_y").agg(order.alias("_o")).orderBy("_o", "_x", "_y").limit(k).collect()
    centres = [(float(r["_x"]), float(r["_y"])) for r in start]

    def nearest(at: list[tuple[float, float]]) -> Column:
        options = F.array(*[F.struct(_squared(F.col("_x"), F.col("_y"), *c).alias("d"), F.lit(n).alias("n")) for n, c in enumerate(at)])
        return F.array_min(options)["n"]

    def sums(clustered: DataFrame) -> dict[int, list[int]]:
        rows = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy")).collect()
        return {r["cluster"]: [r["n"], r["sx"], r["sy"]] for r in rows}

    if not centres:
        return points.select(region_col, F.lit(0).alias("cluster")), []
    held: dict[int, list[int]] = {}
    for _ in range(50):
        now = sums(points.withColumn("cluster", nearest(centres)))
        if now == held:
            break
        held = now
        centres = [(held[n][1] / held[n][0], held[n][2] / held[n][0]) if n in held else c for n, c in enumerate(centres)]
    clustered = cut(points.withColumn("cluster", nearest(centres)))
    held = sums(clustered)
    moved: dict = {}
    while True:
        state = clustered
        if moved:
            new = F.create_map(*[F.lit(v) for pair in moved.items() for v in pair])
            state = clustered.withColumn("cluster", F.coalesce(F.try_element_at(new, F.col(region_col)), F.col("cluster")))
            if len(moved) > _KEPT_MOVES:
                state = clustered = cut(state)
                moved = {}
        offers = []
        for n, (count, sx, sy) in held.items():
            d = _squared(F.col("_x"), F.col("_y"), sx / count, sy / count)
            own = F.lit(count / (count - 1)) * d if count > 1 else F.lit(None).cast("double")  # the last one stays
            offers.append(F.struct(F.lit(n).alias("n"), (F.lit(count / (count + 1)) * d).alias("into"), own.alias("out")))
        here = state.withColumn("_o", F.array(*offers))
        here = here.withColumn("_out", F.filter("_o", lambda o: o["n"] == F.col("cluster"))[0]["out"])
        moves = here.select("*", F.inline("_o")).where("n <> cluster AND _out IS NOT NULL").withColumn("change", F.col("into") - F.col("_out"))
        moves = moves.where(F.col("change") < -1e-9 * F.col("_out"))
        best = moves.groupBy("cluster", "n").agg(F.min(F.struct("change", region_col, "_x", "_y")).alias("m")).collect()  # k * (k - 1) rows
        busy: set[int] = set()
        for r in sorted(best, key=lambda r: (r["m"]["change"], r["m"][region_col])):
            a, b = r["cluster"], r["n"]
            if a in busy or b in busy:
                continue
            busy |= {a, b}
            moved[r["m"][region_col]] = b
            for c, sign in ((a, -1), (b, 1)):
                held[c] = [held[c][0] + sign, held[c][1] + sign * r["m"]["_x"], held[c][2] + sign * r["m"]["_y"]]
        if not busy:
            break
    centres = [(sx / n / _PARTS, sy / n / _PARTS) for _, (n, sx, sy) in sorted(held.items())]
    number = {old: new for new, old in enumerate(sorted(held), start=1)}
    numbered = F.create_map(*[F.lit(v) for pair in number.items() for v in pair])
    return state.select(region_col, F.element_at(numbered, F.col("cluster")).alias("cluster")), centres


def kmeans_centres(districts: DataFrame, k: int, seed: int, x: str = "x", y: str = "y", region_col: str = "region") -> list[tuple[float, float]]:
    """Cluster centres of the district centroids (k points: fold metadata)."""
    return kmeans(districts, k, seed, region_col, x, y)[1]


def _smallest(ranks: DataFrame, column: Column, place: int, n: int) -> int:
    """The ``place``-th smallest of different ranks 1..n, by counts of blocks and then inside one block."""
    if place == 0:
        return 0
    width = max(1, n // 4096)
    blocks = ranks.groupBy(F.floor((column - 1) / width).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    for r in sorted(blocks):
        if r["n"] >= place:
            inside = ranks.where(F.floor((column - 1) / width) == r["b"]).select(column.alias("r")).collect()
            return sorted(x["r"] for x in inside)[place - 1]
        place -= r["n"]
    raise ValueError("fewer ranks than the place asked for")


def balanced_clusters(
    districts: DataFrame,
    centres: Sequence[tuple[float, float]],
    region_col: str = "region",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """``region, cluster`` with cluster sizes floor(n/k) or ceil(n/k).

    Pass 1 visits clusters 1..k in order; each takes its floor(n/k) nearest free districts.  Pass 2 gives the fewer
    than k left over districts, in name order, to the nearest cluster that still has room.  Ties go to the lower
    name or cluster number.

    All districts are ranked by their distance to every centre once.  A cluster's share ends at some rank, so what is
    left for the next one is a filter on the ranks, and pass 1 is k bounds instead of k tables.
    """
    k = len(centres)
    options = F.array(
        *[F.struct(F.lit(n).alias("cluster"), _squared(F.col(x), F.col(y), *c).alias("_d2")) for n, c in enumerate(centres, start=1)]
    )
    pairs = districts.select(region_col, F.col(x).alias("_x"), F.col(y).alias("_y"), F.inline(options)).withColumn("_one", F.lit(1))
    ranked = running_totals(pairs, ["_d2", region_col], {"_rank": "_one"}, ["cluster"])
    by_cluster = F.transform(F.sort_array(F.collect_list(F.struct("cluster", "_rank"))), lambda s: s["_rank"])
    ranks = cut(ranked.groupBy(region_col).agg(by_cluster.alias("_ranks"), F.max("_x").alias("_x"), F.max("_y").alias("_y")))
    n = ranks.count()
    free, number = F.lit(True), F.lit(None).cast("int")
    for j in range(k):
        rank = F.col("_ranks")[j]
        last = _smallest(ranks.where(free), rank, n // k, n)
        number = F.coalesce(number, F.when(rank <= last, F.lit(j + 1)))
        free = free & (rank > last)
    taken = ranks.where(~free).select(region_col, number.alias("cluster"))
    # Every cluster now holds floor(n/k) districts, so each can take one of the (< k) left over ones.
    room = set(range(1, k + 1))
    placed = []
    for row in sorted(ranks.where(free).collect(), key=lambda r: r[region_col]):
        best = min(room, key=lambda c: ((row["_x"] - centres[c - 1][0]) ** 2 + (row["_y"] - centres[c - 1][1]) ** 2, c))
        room.discard(best)
        placed.append((row[region_col], best))
    if placed:
        kind = districts.schema[region_col].dataType.simpleString()
        extra = districts.sparkSession.createDataFrame(placed, f"{region_col} {kind}, cluster int")
        taken = taken.unionByName(extra)
    return taken


def inner_assignments(clusters: DataFrame, region_col: str = "region") -> DataFrame:
    """``region, inner_fold, inner_role``: a district assesses its own cluster's fold and trains the others."""
    k = clusters.agg(F.max("cluster")).scalar()
    return clusters.withColumn("inner_fold", F.explode(F.sequence(F.lit(1), k))).select(
        region_col,
        "inner_fold",
        F.when(F.col("cluster") == F.col("inner_fold"), "assess").otherwise("train").alias("inner_role"),
    )


def fold_assignments(
    data: DataFrame,
    districts: DataFrame,
    start_date: str,
    end_date: str,
    horizon: int = 90,
    step: int = 90,
    n_spatial_folds: int = 10,
    region_col: str = "region",
    seed: int = 10001,
) -> tuple[DataFrame, DataFrame]:
    """The two fold tables: by date (outer) and by district (inner)."""
    centres = kmeans_centres(districts, n_spatial_folds, seed, region_col=region_col)
    clusters = balanced_clusters(districts, centres, region_col)
    return outer_assignments(data, start_date, end_date, horizon, step), inner_assignments(clusters, region_col)


def fold_rows(
    data: DataFrame,
    outer: DataFrame,
    fold_id: int,
    inner: DataFrame | None = None,
    inner_fold: int | None = None,
    region_col: str = "region",
    unlisted: str | None = None,
) -> DataFrame:
    """Rows of one fold with their ``role``; with an inner fold, the training rows with their ``inner_role``.

    Districts that the inner table does not list for the fold have the role ``unlisted``, or are left out.
    """
    dates = outer.where(F.col("fold_id") == fold_id).select("date", "role")
    rows = data.join(calendar_side(dates), "date")
    if inner is None:
        return rows
    here = inner.where(F.col("inner_fold") == inner_fold).select(region_col, "inner_role")
    rows = rows.where(F.col("role") == "train").join(here, region_col, "inner" if unlisted is None else "left")
    return rows if unlisted is None else rows.withColumn("inner_role", F.coalesce("inner_role", F.lit(unlisted)))


def rolling_origin(
    data: DataFrame, initial: int = 10, assess: int = 1, skip: int = 1, date: str = "date", cumulative: bool = True
) -> DataFrame:
    """Rolling-origin folds over distinct dates: ``date, fold_id, role``.

    Fold i trains on the first ``initial + (i-1) * (skip+1)`` dates and assesses the next ``assess`` dates; folds
    whose assessment would run past the last date do not exist.  The order runs over the calendar of dates.
    """
    days = data.select(date).distinct()
    days = days.withColumn("_r", F.dense_rank().over(Window.orderBy(date)))
    n = days.agg(F.max("_r")).scalar()
    days = days.withColumn("_n", n)
    stride = skip + 1
    folds = F.floor((F.col("_n") - initial - assess) / F.lit(stride)).cast("int") + 1
    first_train = F.greatest(F.ceil((F.col("_r") - initial) / F.lit(stride)).cast("int") + 1, F.lit(1))
    lo = F.greatest(F.ceil((F.col("_r") - initial - assess) / F.lit(stride)).cast("int") + 1, F.lit(1))
    hi = F.least(F.ceil((F.col("_r") - initial) / F.lit(stride)).cast("int"), F.col("_f"))
    days = days.withColumn("_f", folds)
    if cumulative:
        train = days.withColumn("_a", first_train).where(F.col("_a") <= F.col("_f"))
        train = train.withColumn("_b", F.col("_f"))
    else:  # a moving window of the last ``initial`` dates
        train = days.withColumns(
            {"_a": first_train, "_b": F.least(F.floor((F.col("_r") - 1) / F.lit(stride)).cast("int") + 1, F.col("_f"))}
        ).where(F.col("_a") <= F.col("_b"))
    trained = train.select(date, F.explode(F.sequence("_a", "_b")).alias("fold_id"), F.lit("train").alias("role"))
    assessed = (
        days.withColumns({"_a": lo, "_b": hi})
        .where(F.col("_a") <= F.col("_b"))
        .select(date, F.explode(F.sequence("_a", "_b")).alias("fold_id"), F.lit("assess").alias("role"))
    )
    return trained.unionByName(assessed)


def rolling_origin_bounds(spark: SparkSession, n: int, initial: int, assess: int, skip: int) -> DataFrame:
    """Rolling-origin folds over ``n`` ordered rows, as rank bounds: ``fold_id, train_to, assess_from, assess_to``.

    A row of rank r trains fold i when ``r <= train_to``.  Ranks come from
    :func:`fieldgrid.operators.ranks.row_numbers`; one row per fold, not per row and fold.
    """
    stops = spark.sql(f"SELECT posexplode(sequence({initial}L, greatest({n - assess}L, {initial}L), {skip + 1}L)) AS (i, stop)")
    return stops.where(F.col("stop") <= n - assess).select(
        (F.col("i") + 1).alias("fold_id"),
        F.col("stop").alias("train_to"),
        (F.col("stop") + 1).alias("assess_from"),
        (F.col("stop") + assess).alias("assess_to"),
    )


def rolling_origin_rows(data: DataFrame, order: Sequence[str], initial: int, assess: int, skip: int) -> DataFrame:
    """Every row with the folds it belongs to, as bounds: ``trains_from``, ``assess_from``, ``assess_to``.

    Fold i trains on the first ``initial + (i - 1) * (skip + 1)`` rows in ``order`` and assesses the next ``assess``.  A row
    trains fold ``trains_from`` and all later ones, and assesses the folds from ``assess_from`` to ``assess_to``; bounds are
    NULL where there is no such fold.  No row is copied, however many folds there are.
    """
    numbered = row_numbers(data, order, "_r")
    n = numbered.count()
    stride, last = skip + 1, max(0, (n - initial - assess) // (skip + 1) + 1)
    r = F.col("_r")
    trains = F.greatest(F.ceil((r - initial) / stride) + 1, F.lit(1))
    low = F.greatest(F.ceil((r - initial - assess) / stride) + 1, F.lit(1))
    high = F.least(F.ceil((r - initial) / stride), F.lit(last))
    bounds = {"trains_from": F.when(trains <= last, trains), "assess_from": F.when(low <= high, low), "assess_to": F.when(low <= high, high)}
    return numbered.withColumns({k: v.cast("int") for k, v in bounds.items()}).drop("_r")


def fold_totals(bounds: DataFrame, **sums: Column) -> DataFrame:
    """``fold_id`` with ``train_<name>`` and ``assess_<name>``, sums over the rows of each fold of :func:`rolling_origin_rows`.

    Training rows are added up by the fold they enter at; the running total over folds, a table of folds, does the rest.
    """
    entered = bounds.where("trains_from IS NOT NULL").groupBy(F.col("trains_from").alias("fold_id")).agg(*[c.alias(f"_t_{n}") for n, c in sums.items()])
    assessed = bounds.where("assess_from IS NOT NULL").withColumn("fold_id", F.explode(F.sequence("assess_from", "assess_to")))
    assessed = assessed.groupBy("fold_id").agg(*[c.alias(f"assess_{n}") for n, c in sums.items()])
    both = assessed.join(entered, "fold_id", "full")
    upto = Window.orderBy("fold_id").rowsBetween(Window.unboundedPreceding, 0)  # one row a fold
    return both.select("fold_id", *[F.sum(f"_t_{n}").over(upto).alias(f"train_{n}") for n in sums], *[f"assess_{n}" for n in sums])


def leave_location_out(data: DataFrame, location: str) -> DataFrame:
    """``location, inner_fold, inner_role``: each location is left out once (folds numbered in name order).

    One row per location, the fold that assesses it; it trains all others (``fold_rows(..., unlisted="train")``), so
    nothing grows with the square of the locations.
    """
    places = row_numbers(data.select(location).distinct(), [location], "inner_fold")
    return places.select(location, F.col("inner_fold").cast("int").alias("inner_fold"), F.lit("assess").alias("inner_role"))


def holdout_split(data: DataFrame, cut: str, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Training rows before ``cut`` and holdout rows from ``cut`` on."""
    at = F.to_date(F.lit(cut))
    return data.where(F.col(date) < at), data.where(F.col(date) >= at)
