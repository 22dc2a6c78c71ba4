"""Checks of folds, tuning and metrics (ids M1..M13, W9, O3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import with_date_parts
from ..plans import folds, modelling
from . import adapters as a
from .registry import cte, query

START, END, HORIZON, STEP = "1996-01-01", "2000-12-31", 90, 90


@query(
    "M01_outer_folds",
    f"""SELECT r.date, f.fold_id, CASE WHEN r.date <= f.train_end THEN 'train' ELSE 'assess' END AS role
    FROM (SELECT DISTINCT date FROM region_rows) r JOIN (SELECT CAST(i + 1 AS INT) AS fold_id, DATE '{START}' + CAST(i * {STEP} AS INT) AS train_end
      FROM (SELECT unnest(range(100)) AS i) WHERE DATE '{START}' + CAST(i * {STEP} AS INT) <= DATE '{END}') f ON r.date <= f.train_end + {HORIZON}""",
)
def _(spark, d):
    return folds.outer_assignments(a.region_rows(spark, d), START, END, HORIZON, STEP)


@query("M01_outer_fold_table", f"SELECT CAST(i + 1 AS INT) AS fold_id, t AS train_end, t + 1 AS assess_start, t + {HORIZON} AS assess_end, (SELECT count(*) FROM region_rows WHERE date > t AND date <= t + {HORIZON}) AS n_assess FROM (SELECT i, DATE '{START}' + CAST(i * {STEP} AS INT) AS t FROM (SELECT unnest(range(100)) AS i)) WHERE t <= DATE '{END}'")
def _(spark, d):
    table = folds.outer_folds(spark, START, END, HORIZON, STEP)
    assigned = folds.outer_assignments(a.region_rows(spark, d), START, END, HORIZON, STEP).where("role = 'assess'")
    counts = a.region_rows(spark, d).join(assigned, "date").groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_assess"))
    return table.join(counts, "fold_id", "left").fillna(0, ["n_assess"])


cte("dist", "SELECT n_name AS region, x, CAST(c_nationkey AS DOUBLE) AS y, c_nationkey % 4 + 1 AS cluster FROM (SELECT c_nationkey, avg(c_acctbal) / 1000 AS x FROM customer GROUP BY 1) JOIN nation ON n_nationkey = c_nationkey")
cte("centres", "SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM dist GROUP BY 1")



@query("M02_kmeans_centroids", "SELECT region, 4 AS clusters, 0 AS better_moves FROM dist")
def _(spark, d):
    """Of every district, how many single moves into another cluster would lower the sum of squares."""
    dist = a.districts(spark, d)
    clustered, _ = folds.kmeans(dist, 4, 10001)
    points = dist.join(clustered, "region")
    stats = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    packed = stats.select(F.collect_list(F.struct(F.col("cluster").alias("other"), "n", "cx", "cy"))).scalar()
    pairs = points.withColumn("clusters", F.size(packed)).select("*", F.inline(packed))
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    own = F.col("cluster") == F.col("other")
    out = F.max(F.when(own, F.when(F.col("n") > 1, F.col("n") / (F.col("n") - 1) * d2).otherwise(0)))
    least = F.min(F.when(~own, F.col("n") / (F.col("n") + 1) * d2))
    costs = pairs.groupBy("region", "clusters").agg(out.alias("out"), least.alias("least"))
    return costs.select("region", "clusters", (F.col("least") < F.col("out") - 1e-6).cast("int").alias("better_moves"))


def _in_turn(k: int = 4) -> str:
    """Clusters one after another, each with its nearest free districts; then those left over, one after another."""
    near = "pow(d.x - c.cx, 2) + pow(d.y - c.cy, 2)"
    steps = [f"p AS MATERIALIZED (SELECT d.region, c.cluster, {near} AS d2, (SELECT count(*) FROM dist) // {k} AS size FROM (SELECT region, x, y FROM dist) d, centres c)", "t0 AS (SELECT '' AS region, 0 AS cluster WHERE false)"]
    for n in range(1, k + 1):
        steps.append(
            f"t{n} AS MATERIALIZED (SELECT * FROM t{n - 1} UNION ALL SELECT region, cluster FROM (SELECT region, cluster, size, row_number() OVER (ORDER BY d2, region) AS place FROM p WHERE cluster = {n} AND region NOT IN (SELECT region FROM t{n - 1})) WHERE place <= size)"
        )
    steps.append(f"l0 AS (SELECT * FROM t0), rest AS MATERIALIZED (SELECT region, row_number() OVER (ORDER BY region) AS place FROM dist WHERE region NOT IN (SELECT region FROM t{k}))")
    for n in range(1, k):
        steps.append(
            f"l{n} AS MATERIALIZED (SELECT * FROM l{n - 1} UNION ALL SELECT region, cluster FROM (SELECT p.region, p.cluster, row_number() OVER (ORDER BY d2, p.cluster) AS o FROM p JOIN rest USING (region) WHERE rest.place = {n} AND p.cluster NOT IN (SELECT cluster FROM l{n - 1})) WHERE o = 1)"
        )
    return f"SELECT * FROM (WITH {', '.join(steps)} SELECT region, CAST(cluster AS INT) AS cluster FROM t{k} UNION ALL SELECT region, CAST(cluster AS INT) FROM l{k - 1})"


@query("M03_balanced_clusters", _in_turn())
def _(spark, d):
    dist = a.districts(spark, d)
    centres = dist.join(given_clusters(spark, d), "region").groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return folds.balanced_clusters(dist, [(r["cx"], r["cy"]) for r in centres.orderBy("cluster").collect()])


@query(
    "M01_fold_labels",
    f"""SELECT CAST(i + 1 AS INT) AS fold_id, CAST((SELECT min(date) FROM region_rows) AS VARCHAR) || ' ' || CAST(t AS VARCHAR) AS train_range, CAST(t + 1 AS VARCHAR) || ' ' || CAST(t + {HORIZON} AS VARCHAR) AS assess_range
    FROM (SELECT i, DATE '{START}' + CAST(i * {STEP} AS INT) AS t FROM (SELECT unnest(range(100)) AS i)) WHERE t <= DATE '{END}'""",
)
def _(spark, d):
    table = folds.outer_folds(spark, START, END, HORIZON, STEP)
    return folds.fold_labels(table, a.region_rows(spark, d)).select("fold_id", "train_range", "assess_range")


def given_clusters(spark, d):
    """A fixed assignment of nations to clusters, for checking what follows from it."""
    return a.table(spark, d, "nation").select(F.col("n_name").alias("region"), (F.col("n_nationkey") % 4 + 1).alias("cluster"))


cte("clusters", "SELECT n_name AS region, n_nationkey % 4 + 1 AS cluster FROM nation")


@query("M04_inner_folds", "SELECT region, CAST(i AS INT) AS inner_fold, CASE WHEN cluster = i THEN 'assess' ELSE 'train' END AS inner_role FROM clusters, (SELECT unnest(range(1, 5)) AS i)")
def _(spark, d):
    return folds.inner_assignments(given_clusters(spark, d))


@query(
    "M04_inner_fold_rows",
    f"""SELECT r.region, r.date, r.quantity, CASE WHEN c.cluster = 3 THEN 'assess' ELSE 'train' END AS inner_role FROM region_rows r JOIN clusters c USING (region) WHERE r.date <= DATE '{START}' + {4 * STEP}""",
    "quantity",
)
def _(spark, d):
    rows = a.region_rows(spark, d).drop("outbreak")
    outer = folds.outer_assignments(rows, START, END, HORIZON, STEP)
    return folds.fold_rows(rows, outer, 5, folds.inner_assignments(given_clusters(spark, d)), 3).drop("role")


cte("ranked_days", "SELECT date, dense_rank() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM region_rows)")


@query(
    "M05_rolling_origin",
    """SELECT date, CAST(f + 1 AS INT) AS fold_id, CASE WHEN r <= 10 + 50 * f THEN 'train' ELSE 'assess' END AS role
    FROM ranked_days, (SELECT unnest(range(200)) AS f) WHERE 10 + 50 * f + 5 <= n AND r <= 10 + 50 * f + 5""",
)
def _(spark, d):
    return folds.rolling_origin(a.region_rows(spark, d), initial=10, assess=5, skip=49)


@query(
    "M05_rolling_origin_rows",
    """SELECT f + 1 AS fold_id, s.stop AS train_to, s.stop + 1 AS assess_from, s.stop + 100 AS assess_to FROM (SELECT f, 100 + 1001 * f AS stop FROM (SELECT unnest(range(1000)) AS f)) s
    WHERE s.stop <= (SELECT count(*) FROM region_rows) - 100""",
)
def _(spark, d):
    n = a.region_rows(spark, d).count()
    out = folds.rolling_origin_bounds(spark, n, 100, 100, 1000)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query(
    "M05_rolling_origin_totals",
    """WITH o AS (SELECT quantity, row_number() OVER (ORDER BY date, region) AS r, count(*) OVER () AS n FROM region_rows),
    f AS (SELECT i, 500 + i * 300 AS stop FROM (SELECT unnest(range(1000)) AS i) WHERE 500 + i * 300 + 400 <= (SELECT count(*) FROM region_rows))
    SELECT CAST(f.i + 1 AS INT) AS fold_id, sum(CASE WHEN o.r <= f.stop THEN o.quantity END) AS train_quantity, CAST(sum(CASE WHEN o.r <= f.stop THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
      sum(CASE WHEN o.r > f.stop THEN o.quantity END) AS assess_quantity, CAST(sum(CASE WHEN o.r > f.stop THEN 1 ELSE 0 END) AS BIGINT) AS assess_rows
    FROM f JOIN o ON o.r <= f.stop + 400 GROUP BY f.i""",
    "train_quantity assess_quantity",
)
def _(spark, d):
    """Folds over ordered rows, 400 assessed rows every 300: totals of what each trains on and assesses."""
    bounds = folds.rolling_origin_rows(a.region_rows(spark, d), ["date", "region"], 500, 400, 299)
    out = folds.fold_totals(bounds, quantity=F.sum("quantity"), rows=F.count(F.lit(1)))
    return out.select("fold_id", "train_quantity", "train_rows", "assess_quantity", "assess_rows")


@query("M05_leave_location_out", "SELECT region, CAST(row_number() OVER (ORDER BY region) AS INT) AS inner_fold, 'assess' AS inner_role FROM (SELECT DISTINCT region FROM region_rows)")
def _(spark, d):
    return folds.leave_location_out(a.region_rows(spark, d), "region")


@query("M06_holdout_split", "SELECT region, date, date < DATE '2000-01-01' AS is_train FROM region_rows")
def _(spark, d):
    train, rest = folds.holdout_split(a.region_rows(spark, d), "2000-01-01")
    cols = lambda df, v: df.select("region", "date", F.lit(v).alias("is_train"))
    return cols(train, True).unionByName(cols(rest, False))


def features(spark, d):
    return with_date_parts(a.region_rows(spark, d), "date", ["doy", "month"])


@query("M07_feature_recipe", "SELECT region, date, 'quantity,doy,month' AS used, quantity + dayofyear(date) + month(date) AS total FROM region_rows", "total")
def _(spark, d):
    """Identifiers and the label are dropped from the predictors."""
    df = features(spark, d)
    used = modelling.feature_columns(df)
    return df.select("region", "date", F.lit(",".join(used)).alias("used"), sum((F.col(c) for c in used), F.lit(0.0)).alias("total"))


_AUC = """SELECT p.fold, avg(CASE WHEN p.pred_1 > n.pred_1 THEN 1 WHEN p.pred_1 = n.pred_1 THEN 5e-1 ELSE 0 END) AS roc_auc
  FROM (SELECT * FROM scored WHERE outbreak = 1) p JOIN (SELECT * FROM scored WHERE outbreak = 0) n USING (fold) GROUP BY 1"""
_PR = """SELECT fold, sum((rec - coalesce(prev_rec, 0)) * (prec + coalesce(prev_prec, 1)) / 2) AS pr_auc FROM (
  SELECT *, lag(rec) OVER (PARTITION BY fold ORDER BY s DESC) AS prev_rec, lag(prec) OVER (PARTITION BY fold ORDER BY s DESC) AS prev_prec FROM (
    SELECT t.fold, t.s, sum(x.outbreak) / (SELECT sum(outbreak) FROM scored z WHERE z.fold = t.fold) AS rec, avg(x.outbreak) AS prec
    FROM (SELECT DISTINCT fold, pred_1 AS s FROM scored) t JOIN scored x ON x.fold = t.fold AND x.pred_1 >= t.s GROUP BY 1, 2)) GROUP BY 1"""
_CELLS = """SELECT fold, tp / (tp + fn) AS recall, tp / nullif(tp + fp, 0) AS precision, 2 * tp / (2 * tp + fp + fn) AS f_meas, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS bal_accuracy FROM (
  SELECT fold, sum(CASE WHEN pred_1 >= 5e-1 AND outbreak = 1 THEN 1e0 ELSE 0 END) AS tp, sum(CASE WHEN pred_1 >= 5e-1 AND outbreak = 0 THEN 1e0 ELSE 0 END) AS fp,
    sum(CASE WHEN pred_1 < 5e-1 AND outbreak = 1 THEN 1e0 ELSE 0 END) AS fn, sum(CASE WHEN pred_1 < 5e-1 AND outbreak = 0 THEN 1e0 ELSE 0 END) AS tn FROM scored GROUP BY 1)"""
cte("metrics", f"SELECT * FROM ({_AUC}) JOIN ({_PR}) USING (fold) JOIN ({_CELLS}) USING (fold)")


@query("M10_metrics", "SELECT * FROM metrics", "roc_auc pr_auc recall precision f_meas bal_accuracy")
def _(spark, d):
    return modelling.classification_metrics(a.scored(spark, d), ["fold"])


@query(
    "M11_select_best",
    "SELECT setting, 'roc_auc' AS metric, count(*) AS n, stddev_samp(roc_auc) AS sd, avg(roc_auc) AS estimate FROM (SELECT fold % 2 AS setting, roc_auc FROM metrics) GROUP BY 1 ORDER BY estimate DESC LIMIT 1",
    "sd estimate",
)
def _(spark, d):
    """Folds stand in for two settings with two resamples each."""
    m = modelling.classification_metrics(a.scored(spark, d), ["fold"])
    long = modelling.metrics_long(m.withColumn("setting", F.col("fold") % 2), ["setting", "fold"])
    return modelling.select_best(long, ["setting"])


@query(
    "M13_roc_curve",
    """SELECT CASE WHEN s IS NULL THEN 'end' ELSE 'score' END AS kind, coalesce(s, 0) AS threshold, specificity, sensitivity FROM (
      SELECT t.s, avg(CASE WHEN x.outbreak = 0 THEN CASE WHEN x.pred_1 < t.s THEN 1e0 ELSE 0 END END) AS specificity, avg(CASE WHEN x.outbreak = 1 THEN CASE WHEN x.pred_1 >= t.s THEN 1e0 ELSE 0 END END) AS sensitivity
      FROM (SELECT DISTINCT pred_1 AS s FROM scored) t, scored x GROUP BY 1 UNION ALL SELECT NULL, 0, 1 UNION ALL SELECT NULL, 1, 0)""",
    "threshold specificity sensitivity",
)
def _(spark, d):
    curve = modelling.roc_curve(a.scored(spark, d))
    is_end = F.abs("threshold") == F.lit(float("inf"))
    return curve.select(F.when(is_end, "end").otherwise("score").alias("kind"), F.when(is_end, 0.0).otherwise(F.col("threshold")).alias("threshold"), "specificity", "sensitivity")


def distances(spark, d):
    """Districts with their squared distance to the centre of each given cluster (k rows per district)."""
    dist = a.districts(spark, d).join(given_clusters(spark, d), "region")
    centres = dist.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    packed = centres.select(F.collect_list(F.struct("cluster", "cx", "cy"))).scalar()
    pairs = dist.drop("cluster").withColumn("_c", packed).select("*", F.inline("_c")).drop("_c")
    return pairs.withColumn("d2", F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))


@query("W09_centroid_ranks", "SELECT region, cluster, row_number() OVER (PARTITION BY region ORDER BY pow(x - cx, 2) + pow(y - cy, 2), cluster) AS place FROM (SELECT region, x, y FROM dist), centres")
def _(spark, d):
    w = Window.partitionBy("region").orderBy("d2", "cluster")
    return distances(spark, d).select("region", "cluster", F.row_number().over(w).cast("long").alias("place"))


@query("O03_nearest_per_cluster", "SELECT region, cluster FROM (SELECT region, cluster, row_number() OVER (PARTITION BY cluster ORDER BY pow(x - cx, 2) + pow(y - cy, 2), region) AS place FROM (SELECT region, x, y FROM dist), centres) WHERE place <= 3")
def _(spark, d):
    """Top 3 per group; the rank filter is applied before the shuffle as well."""
    w = Window.partitionBy("cluster").orderBy("d2", "region")
    return distances(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 3").select("region", "cluster")
