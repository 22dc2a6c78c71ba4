"""Checks of boosted trees, nested tuning and the final fit (ids M8, M9, M11..M13), with the whole growth in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import with_date_parts
from ..plans import boosting, folds, modelling
from ..session import cut
from . import adapters as a
from .q_model import given_clusters
from .registry import cte, query

FEATURES = ["quantity", "doy", "month", "gaps"]
CUT_DATE = "2000-01-01"
START, END, HORIZON, STEP = "1996-06-01", "1999-12-31", 90, 180
BINS = 12

_GAPS = "CASE WHEN day(date) % 3 = 0 THEN NULL WHEN day(date) % 3 = 1 THEN {nan} ELSE quantity * month(date) END"
cte("boost_data", f"SELECT row_number() OVER (ORDER BY region, date) AS rid, region, date, outbreak AS y, quantity, dayofyear(date) AS doy, month(date) AS month, {_GAPS.format(nan='CAST(5 AS DOUBLE)')} AS gaps FROM region_rows")


def rows(spark, d):
    """District-days with a feature that is missing on every third day; stored, as folds, cuts and fits all read them."""
    days = with_date_parts(a.region_rows(spark, d), "date", ["doy", "month"])
    return cut(days.withColumn("gaps", F.expr(_GAPS.format(nan="5D"))))


def grown(rows_sql: str, members: str, settings: list[dict], min_n: float = 12.0, bins: int = BINS) -> str:
    """Views up to ``grown(model, rid, trains, m)``: margins of all models after their last tree.

    ``rows_sql`` gives the rows that features are cut by; ``members`` gives ``model, k, rid, trains``, k being the number
    of the setting.
    """
    values = ", ".join(f"({k}, {s['trees']}, {s['tree_depth']}, CAST({s['learn_rate']} AS DOUBLE), CAST({s['loss_reduction']} AS DOUBLE))" for k, s in enumerate(settings))
    xs = ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)
    long = f"SELECT rid, unnest({list(range(len(FEATURES)))}) AS f, unnest([{xs}]) AS x FROM"
    views = [
        f"b_setting(k, trees, depth, eta, gamma) AS (VALUES {values})",
        f"b_counts AS (SELECT f, x, count(*) AS n FROM ({long} ({rows_sql})) WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY f, x)",
        "b_steps AS (SELECT f, x, n, sum(n) OVER (PARTITION BY f ORDER BY x) AS upto, sum(n) OVER (PARTITION BY f) AS total FROM b_counts)",
        f"b_cuts AS MATERIALIZED (SELECT f, list(x ORDER BY x) AS cuts FROM b_steps WHERE upto < total AND (upto * {bins}) // total > ((upto - n) * {bins}) // total GROUP BY f)",
        f"b_bins AS MATERIALIZED (SELECT l.rid, l.f, CASE WHEN l.x IS NULL OR isnan(l.x) THEN 0 ELSE 1 + len(list_filter(coalesce(c.cuts, []), lambda e: e < l.x)) END AS bin FROM ({long} boost_data) l LEFT JOIN b_cuts c USING (f))",
        "b_wide AS MATERIALIZED (SELECT rid, list(bin ORDER BY f) AS bins FROM b_bins GROUP BY rid)",
        f"m0 AS MATERIALIZED (SELECT b.model, b.k, b.rid, b.trains, r.y, CAST(0 AS DOUBLE) AS m FROM ({members}) b JOIN boost_data r USING (rid))",
    ]
    for t in range(max(s["trees"] for s in settings)):
        depth = max(s["tree_depth"] for s in settings if s["trees"] > t)
        views.append(
            f"""s{t}_0 AS MATERIALIZED (SELECT model, k, rid, trains, 1 AS node, CAST(round_even((p - y) * 1048576, 0) AS BIGINT) AS g, CAST(greatest(round_even(p * (1 - p) * 1048576, 0), 1) AS BIGINT) AS h
            FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM m{t}))"""
        )
        for level in range(depth):
            s = f"s{t}_{level}"
            views += [
                f"""c{s} AS (SELECT s.model, s.k, s.node, u.f, u.bin, sum(s.g) AS g, sum(s.h) AS h FROM {s} s JOIN b_setting x USING (k) JOIN b_bins u USING (rid)
                WHERE s.trains AND x.trees > {t} AND x.depth > {level} GROUP BY ALL)""",
                f"""w{s} AS (SELECT model, k, node, f, bin, CAST(sum(g) OVER f AS DOUBLE) / 1048576 AS ga, CAST(sum(h) OVER f AS DOUBLE) / 1048576 AS ha, CAST(sum(g) OVER u AS DOUBLE) / 1048576 AS gu, CAST(sum(h) OVER u AS DOUBLE) / 1048576 AS hu,
                CAST(sum(CASE WHEN bin = 0 THEN g ELSE 0 END) OVER f AS DOUBLE) / 1048576 AS gm, CAST(sum(CASE WHEN bin = 0 THEN h ELSE 0 END) OVER f AS DOUBLE) / 1048576 AS hm
                FROM c{s} WINDOW f AS (PARTITION BY model, node, f), u AS (PARTITION BY model, node, f ORDER BY bin))""",
                f"""t{s} AS (SELECT *, ga - gl AS gr, ha - hl AS hr FROM (SELECT *, false AS missing_left, gu - gm AS gl, hu - hm AS hl FROM w{s} UNION ALL SELECT *, true, gu, hu FROM w{s}))""",
                f"""best{s} AS MATERIALIZED (SELECT * FROM (SELECT t.*, (gl * gl / (hl + 1) + gr * gr / (hr + 1)) - ga * ga / (ha + 1) AS gain, x.gamma FROM t{s} t JOIN b_setting x USING (k))
                WHERE bin > 0 AND least(hl, hr) > 0 AND least(hl, hr) >= {min_n} AND gain > greatest(gamma, 1e-6)
                QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, bin, missing_left) = 1)""",
                f"""s{t}_{level + 1} AS MATERIALIZED (SELECT s.model, s.k, s.rid, s.trains, s.g, s.h,
                CASE WHEN b.f IS NULL THEN s.node WHEN (w.bins[b.f + 1] = 0 AND b.missing_left) OR (w.bins[b.f + 1] > 0 AND w.bins[b.f + 1] <= b.bin) THEN 2 * s.node ELSE 2 * s.node + 1 END AS node
                FROM {s} s JOIN b_wide w USING (rid) LEFT JOIN best{s} b ON b.model = s.model AND b.node = s.node)""",
            ]
        last = f"s{t}_{depth}"
        views += [
            f"v{t} AS (SELECT model, node, -any_value(eta) * ((CAST(sum(g) AS DOUBLE) / 1048576) / (CAST(sum(h) AS DOUBLE) / 1048576 + 1)) AS v FROM {last} JOIN b_setting USING (k) WHERE trains AND trees > {t} GROUP BY model, node)",
            f"m{t + 1} AS MATERIALIZED (SELECT m.model, m.k, m.rid, m.trains, m.y, m.m + coalesce(v.v, 0) AS m FROM m{t} m JOIN {last} s ON s.model = m.model AND s.rid = m.rid LEFT JOIN v{t} v ON v.model = s.model AND v.node = s.node)",
        ]
    views.append(f"grown AS (SELECT * FROM m{max(s['trees'] for s in settings)})")
    return ",\n".join(views)


def final_sql(settings: list[dict]) -> str:
    """Views up to ``grown`` of one model a setting, trained before the cut date."""
    train = f"SELECT * FROM boost_data WHERE date < DATE '{CUT_DATE}'"
    members = f"SELECT x.k AS model, x.k, r.rid, r.date < DATE '{CUT_DATE}' AS trains FROM boost_data r, b_setting x"
    return grown(train, members, settings)


_PREDICTIONS = "SELECT r.region, r.date, r.y AS outbreak, 1 / (1 + exp(-g.m)) AS pred_1, CAST(1 / (1 + exp(-g.m)) >= 5e-1 AS INT) AS pred_class FROM grown g JOIN boost_data r USING (rid) WHERE NOT g.trains"

STUMP = {"trees": 1, "tree_depth": 1, "learn_rate": 0.3, "mtry": 4, "loss_reduction": 0.0}
DEEPER = {"trees": 3, "tree_depth": 2, "learn_rate": 0.5, "mtry": 4, "loss_reduction": 0.25}
SETTINGS = [
    {"trees": 1, "tree_depth": 1, "learn_rate": 0.3, "mtry": 4, "loss_reduction": 0.0},
    {"trees": 2, "tree_depth": 2, "learn_rate": 0.5, "mtry": 4, "loss_reduction": 0.1},
    {"trees": 1, "tree_depth": 2, "learn_rate": 0.1, "mtry": 4, "loss_reduction": 2.0},
]


def fitted(spark, d, setting, data=None):
    train, rest = folds.holdout_split(rows(spark, d) if data is None else data, CUT_DATE)
    return modelling.final_fit(train, rest, FEATURES, setting, bins=BINS)


@query("M08_one_split", f"WITH {final_sql([STUMP])} {_PREDICTIONS}", "pred_1")
def _(spark, d):
    """One tree of one split before a cut date, scored after it; a feature has missing values."""
    return fitted(spark, d, STUMP).select("region", "date", "outbreak", "pred_1", "pred_class")


@query("M08_boosted_trees", f"WITH {final_sql([DEEPER])} {_PREDICTIONS}", "pred_1")
def _(spark, d):
    """Three trees of two levels with a price for each split."""
    return fitted(spark, d, DEEPER).select("region", "date", "outbreak", "pred_1", "pred_class")


def tuned(spark, d, data=None):
    data, _ = folds.holdout_split(rows(spark, d) if data is None else data, CUT_DATE)
    outer = folds.outer_assignments(data, START, END, HORIZON, STEP)
    return modelling.tune_grid(data, outer, folds.inner_assignments(given_clusters(spark, d)), SETTINGS, FEATURES, bins=BINS)


_TRAIN = f"SELECT * FROM boost_data WHERE date < DATE '{CUT_DATE}'"
_FOLDS = f"""SELECT CAST(o + 1 AS INT) AS outer_fold, CAST(i AS INT) AS inner_fold, DATE '{START}' + CAST(o * {STEP} AS INT) AS train_end
  FROM (SELECT unnest(range(100)) AS o), (SELECT unnest(range(1, 5)) AS i) WHERE DATE '{START}' + CAST(o * {STEP} AS INT) <= DATE '{END}'"""
_MEMBERS = f"""SELECT (f.outer_fold * 100 + f.inner_fold) * 100 + x.k AS model, x.k, r.rid, c.cluster <> f.inner_fold AS trains
  FROM ({_TRAIN}) r JOIN clusters c USING (region) JOIN ({_FOLDS}) f ON r.date <= f.train_end, b_setting x"""
_USED = "CAST(x.trees AS DOUBLE) AS trees, CAST(x.depth AS DOUBLE) AS tree_depth, x.eta AS learn_rate, CAST(4 AS DOUBLE) AS mtry, x.gamma AS loss_reduction"
_TUNED = f"""{grown(_TRAIN, _MEMBERS, SETTINGS)},
judged AS (SELECT model, k, y, 1 / (1 + exp(-m)) AS p FROM grown WHERE NOT trains),
steps AS (SELECT model, p AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM judged GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER u AS cp, sum(neg) OVER u AS cn, sum(pos) OVER (PARTITION BY model) AS ap, sum(neg) OVER (PARTITION BY model) AS an FROM steps WINDOW u AS (PARTITION BY model ORDER BY s DESC)),
areas AS (SELECT model, sum(pos * (an - cn + neg / 2)) / nullif(any_value(ap) * any_value(an), 0) AS roc_auc, sum(pos / nullif(ap, 0) * (cp / (cp + cn) + before) / 2) AS pr_auc
  FROM (SELECT *, lag(cp / (cp + cn), 1, CAST(1 AS DOUBLE)) OVER (PARTITION BY model ORDER BY s DESC) AS before FROM curve) GROUP BY model),
cells AS (SELECT model, any_value(k) AS k, CAST(count(*) FILTER (p >= 5e-1 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p >= 5e-1 AND y = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (p < 5e-1 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (p < 5e-1 AND y = 0) AS DOUBLE) AS tn FROM judged GROUP BY model),
judged_models AS (SELECT model, k, roc_auc, pr_auc, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f_meas,
  (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS bal_accuracy FROM areas JOIN cells USING (model)),
tuned AS (SELECT CAST(model // 10000 AS INT) AS outer_fold, CAST(model // 100 % 100 AS INT) AS inner_fold, k, {_USED}, unnest(['roc_auc', 'pr_auc', 'recall', 'precision', 'f_meas', 'bal_accuracy']) AS metric,
  unnest([roc_auc, pr_auc, recall, precision, f_meas, bal_accuracy]) AS estimate FROM judged_models JOIN b_setting x USING (k))"""


@query("M09_tuning_grid", f"WITH {_TUNED} SELECT * EXCLUDE (k) FROM tuned", "trees tree_depth learn_rate mtry loss_reduction estimate")
def _(spark, d):
    """All settings on all outer and inner folds, grown together; metrics in long form."""
    return tuned(spark, d)


_BEST = "best AS (SELECT k, count(*) AS n, stddev_samp(estimate) AS sd, avg(estimate) AS estimate FROM tuned WHERE metric = 'roc_auc' GROUP BY k ORDER BY avg(estimate) DESC LIMIT 1)"


@query("M11_best_of_nested", f"WITH {_TUNED}, {_BEST} SELECT {_USED}, 'roc_auc' AS metric, b.n, b.sd, b.estimate FROM best b JOIN b_setting x USING (k)", "trees tree_depth learn_rate mtry loss_reduction sd estimate")
def _(spark, d):
    return modelling.select_best(tuned(spark, d), modelling.PARAMETERS)


cte(
    "final_predictions",
    f"WITH {final_sql(SETTINGS)} SELECT g.k, r.region, r.date, r.y AS outbreak, 1 / (1 + exp(-g.m)) AS pred_1, CAST(1 / (1 + exp(-g.m)) >= 5e-1 AS INT) AS pred_class FROM grown g JOIN boost_data r USING (rid) WHERE NOT g.trains",
)


def final(spark, d):
    """Tuning, choice and final fit in one chain."""
    data = rows(spark, d)
    best = modelling.select_best(tuned(spark, d, data), modelling.PARAMETERS).first()
    return fitted(spark, d, {p: best[p] for p in modelling.PARAMETERS}, data)


@query("M08_M12_final_fit", f"WITH {_TUNED}, {_BEST} SELECT p.* EXCLUDE (k) FROM final_predictions p JOIN best USING (k)", "pred_1")
def _(spark, d):
    return final(spark, d).select("region", "date", "outbreak", "pred_1", "pred_class")


@query(
    "M13_holdout_roc_curve",
    f"""WITH {_TUNED}, {_BEST}, p AS MATERIALIZED (SELECT outbreak, pred_1 FROM final_predictions JOIN best USING (k)),
    c AS (SELECT pred_1 AS s, sum(sum(outbreak)) OVER (ORDER BY pred_1 DESC) AS cp, sum(count(*) - sum(outbreak)) OVER (ORDER BY pred_1 DESC) AS cn FROM p GROUP BY pred_1)
    SELECT 'score' AS kind, s AS threshold, ((SELECT count(*) - sum(outbreak) FROM p) - cn) / (SELECT CAST(count(*) - sum(outbreak) AS DOUBLE) FROM p) AS specificity, cp / (SELECT CAST(sum(outbreak) AS DOUBLE) FROM p) AS sensitivity FROM c
    UNION ALL SELECT 'end', 0, 0, 1 UNION ALL SELECT 'end', 0, 1, 0""",
    "threshold specificity sensitivity",
)
def _(spark, d):
    """The curve of the final model on the holdout."""
    curve = modelling.roc_curve(final(spark, d))
    is_end = F.abs("threshold") == F.lit(float("inf"))
    return curve.select(F.when(is_end, "end").otherwise("score").alias("kind"), F.when(is_end, 0.0).otherwise(F.col("threshold")).alias("threshold"), "specificity", "sensitivity")


__all__ = ["boosting", "final", "grown", "rows", "tuned"]
