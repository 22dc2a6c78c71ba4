"""Boosted-tree tuning over folds, metrics and curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators.ranks import running_totals
from .boosting import BINS, MODELS, Model, Setting, assess_all, fit, predict

METRICS = ("roc_auc", "pr_auc", "recall", "precision", "f_meas", "bal_accuracy")
PARAMETERS = ("trees", "tree_depth", "learn_rate", "mtry", "loss_reduction")


def feature_columns(df: DataFrame, label: str = "outbreak", drop: Sequence[str] = ("date", "region", "cases")) -> list[str]:
    """Numeric predictors: everything but the label and the dropped identifiers."""
    unused = {label, *drop}
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in unused]


def parameter_grid(size: int, n_features: int, seed: int = 1) -> list[dict[str, float]]:
    """Space-filling settings: a Latin hypercube with one point per stratum of each parameter.

    Ranges: trees 1-2000, depth 1-15, rate 1e-10-0.1 (log), features 1-n, loss reduction 1e-10-10^1.5 (log).
    """
    rng = np.random.default_rng(seed)
    strata = {p: (rng.permutation(size) + rng.random(size)) / size for p in PARAMETERS}
    out = []
    for i in range(size):
        u = {p: float(strata[p][i]) for p in PARAMETERS}
        out.append(
            {
                "trees": 1 + int(u["trees"] * 2000),
                "tree_depth": 1 + int(u["tree_depth"] * 15),
                "learn_rate": 10 ** (-10 + 9 * u["learn_rate"]),
                "mtry": 1 + int(u["mtry"] * n_features),
                "loss_reduction": 10 ** (-10 + 11.5 * u["loss_reduction"]),
            }
        )
    return out


def setting_of(params: Mapping[str, float], n_features: int, min_n: float = 12.0) -> Setting:
    """Parameters as a setting of :mod:`fieldgrid.plans.boosting`; those not given take its defaults."""
    given = {p: params[p] for p in PARAMETERS if p in params}
    whole = {p: int(given[p]) for p in ("trees", "tree_depth", "mtry") if p in given}
    whole["mtry"] = min(whole.get("mtry", n_features), n_features)
    return Setting(**{**{p: float(v) for p, v in given.items()}, **whole, "min_n": min_n})


def _score_steps(scored: DataFrame, truth: str, score: str, group: Sequence[str]) -> DataFrame:
    """Per distinct score, highest first: positives and negatives at it and at or above it, and the totals."""
    hit = F.col(truth).cast("int")
    steps = scored.groupBy(*group, score).agg(F.sum(hit).alias("_p"), F.sum(1 - hit).alias("_n"))
    totals = steps.groupBy(*group).agg(F.sum("_p").alias("_pos_all"), F.sum("_n").alias("_neg_all"))
    running = running_totals(steps, [F.col(score).desc()], {"_cp": "_p", "_cn": "_n"}, group)
    if group:
        return running.join(totals, list(group))
    both = totals.select(F.struct("_pos_all", "_neg_all")).scalar()
    return running.withColumn("_t", both).select("*", "_t._pos_all", "_t._neg_all").drop("_t")


def classification_metrics(
    scored: DataFrame, group: Sequence[str] = (), truth: str = "outbreak", score: str = "pred_1", threshold: float = 0.5
) -> DataFrame:
    """ROC AUC, PR AUC, recall, precision, F1 and balanced accuracy per group, one row each.

    ROC AUC is the chance that a positive outranks a negative, ties counting half.  PR AUC is the trapezoid area
    from (recall 0, precision 1).  Both are sums over distinct scores, ranked without a single-task sort.
    """
    group = list(group)
    steps = _score_steps(scored, truth, score, group)
    up_to_prev_p, up_to_prev_n = F.col("_cp") - F.col("_p"), F.col("_cn") - F.col("_n")
    precision = F.try_divide(F.col("_cp").cast("double"), F.col("_cp") + F.col("_cn"))
    previous = F.coalesce(F.try_divide(up_to_prev_p.cast("double"), up_to_prev_p + up_to_prev_n), F.lit(1.0))
    below = (F.col("_neg_all") - F.col("_cn")) + F.col("_n") / 2
    areas = steps.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("_p") * below), F.first("_pos_all") * F.first("_neg_all")).alias("roc_auc"),
        F.sum(F.try_divide(F.col("_p").cast("double"), F.col("_pos_all")) * (precision + previous) / 2).alias("pr_auc"),
    )
    yes, hit = F.col(score) >= threshold, F.col(truth).cast("int") == 1
    count = lambda rule: F.sum(rule.cast("int"))
    cells = scored.groupBy(*group).agg(
        count(yes & hit).alias("tp"), count(yes & ~hit).alias("fp"), count(~yes & hit).alias("fn"), count(~yes & ~hit).alias("tn")
    )
    recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    exact = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    cells = cells.select(
        *group,
        recall.alias("recall"),
        exact.alias("precision"),
        F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f_meas"),
        ((recall + F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))) / 2).alias("bal_accuracy"),
    )
    if group:
        return areas.join(cells, group)
    both = cells.select(F.struct(*cells.columns)).scalar()
    return areas.withColumn("_c", both).select("roc_auc", "pr_auc", "_c.*")


def metrics_long(metrics: DataFrame, ids: Sequence[str]) -> DataFrame:
    return metrics.unpivot(list(ids), list(METRICS), "metric", "estimate")


def roc_curve(scored: DataFrame, truth: str = "outbreak", score: str = "pred_1", group: Sequence[str] = ()) -> DataFrame:
    """``threshold, specificity, sensitivity`` at every distinct score, with the two end points of the curve."""
    group = list(group)
    steps = _score_steps(scored, truth, score, group)
    points = steps.select(
        *group,
        F.col(score).alias("threshold"),
        F.try_divide((F.col("_neg_all") - F.col("_cn")).cast("double"), F.col("_neg_all")).alias("specificity"),
        F.try_divide(F.col("_cp").cast("double"), F.col("_pos_all")).alias("sensitivity"),
    )
    groups = scored.groupBy(*group).agg(F.count(F.lit(1)).alias("_k")) if group else scored.agg(F.count(F.lit(1)).alias("_k"))
    ends = F.array(
        F.struct(F.lit(float("-inf")).alias("threshold"), F.lit(0.0).alias("specificity"), F.lit(1.0).alias("sensitivity")),
        F.struct(F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("specificity"), F.lit(0.0).alias("sensitivity")),
    )
    return points.unionByName(groups.withColumn("_e", F.explode(ends)).select(*group, "_e.*"))


def tune_grid(
    data: DataFrame,
    outer: DataFrame,
    inner: DataFrame,
    params: Sequence[Mapping[str, float]],
    features: Sequence[str],
    folds: Sequence[tuple[int, int]] | None = None,
    label: str = "outbreak",
    region_col: str = "region",
    min_n: float = 12.0,
    bins: int = BINS,
    seed: int = 1,
    models_at_once: int = MODELS,
) -> DataFrame:
    """Every setting on every (outer fold, inner fold): metrics in one long table.

    All models grow in shared passes over the data (:func:`fieldgrid.plans.boosting.assess_all`), are scored in one job
    and ranked in one.  Without ``folds``, all pairs of an outer and an inner fold; a pair without rows has no metrics.
    """
    if folds is None:
        numbers = [sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((outer, "fold_id"), (inner, "inner_fold"))]
        folds = [(a, b) for a in numbers[0] for b in numbers[1]]
    models = [Model(setting_of(p, len(features), min_n), a, b) for a, b in folds for p in params]
    scored, _ = assess_all(data, features, models, outer, inner, label, region_col, bins=bins, seed=seed, models_at_once=models_at_once)
    used = [p for p in PARAMETERS if p in params[0]]
    ids = ["outer_fold", "inner_fold", *used]
    table = data.sparkSession.createDataFrame(
        [(m, *folds[m // len(params)], *[float(params[m % len(params)][p]) for p in used]) for m in range(len(models))],
        "model long, outer_fold int, inner_fold int, " + ", ".join(f"{p} double" for p in used),
    )
    found = classification_metrics(scored, ["model"], "truth")
    return metrics_long(found.join(F.broadcast(table), "model").drop("model"), ids)


def select_best(metrics: DataFrame, params: Sequence[str], metric: str = "roc_auc", seed: int = 0) -> DataFrame:
    """Setting with the highest mean estimate over all folds; ties broken by a seeded hash.  One row."""
    params = list(params)
    summary = (
        metrics.where(F.col("metric") == metric)
        .groupBy(*params, "metric")
        .agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("estimate").alias("sd"), F.avg("estimate").alias("estimate"))
    )
    return summary.orderBy(F.col("estimate").desc_nulls_last(), F.xxhash64(*params, F.lit(seed)), *params).limit(1)


def final_fit(
    train: DataFrame, holdout: DataFrame, features: Sequence[str], params: Mapping[str, float], label: str = "outbreak", min_n: float = 12.0, bins: int = BINS, seed: int = 1
) -> DataFrame:
    """Fit the chosen setting on the training rows and score the holdout rows: ``pred_1`` and ``pred_class`` beside them."""
    return predict(fit(train, features, setting_of(params, len(features), min_n), label, bins, seed), holdout)
