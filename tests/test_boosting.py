import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.plans import boosting, folds, modelling
from fieldgrid.plans.boosting import Model, Setting

D = dt.date


def plain_tree(x, g, h, rows, depth, setting, cuts):
    """A tree by trying every cut of every feature: ``(feature, cut, missing left, left, right)`` or a leaf value."""
    gs, hs = g[rows].sum(), h[rows].sum()
    best = None
    if depth:
        for f in range(x.shape[1]):
            v = x[rows, f]
            gone = np.isnan(v)
            for number, edge in enumerate([*cuts[f], math.inf]):
                for missing_left in (False, True):
                    left = rows[(v <= edge) | (gone & missing_left)] if missing_left else rows[(v <= edge) & ~gone]
                    gl, hl = g[left].sum(), h[left].sum()
                    gr, hr = gs - gl, hs - hl
                    if min(hl, hr) <= 0 or min(hl, hr) < setting.min_n:
                        continue
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs**2 / (hs + 1)
                    if gain > max(setting.loss_reduction, boosting.LEAST_GAIN) and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, edge, missing_left, left)
    if best is None:
        return -setting.learn_rate * gs / (hs + 1)
    _, f, edge, missing_left, left = best
    right = np.setdiff1d(rows, left)
    return f, edge, missing_left, plain_tree(x, g, h, left, depth - 1, setting, cuts), plain_tree(x, g, h, right, depth - 1, setting, cuts)


def value(tree, row):
    while isinstance(tree, tuple):
        f, edge, missing_left, left, right = tree
        tree = left if (missing_left if math.isnan(row[f]) else row[f] <= edge) else right
    return tree


def plain_boosting(x, y, setting, cuts):
    margin = np.zeros(len(y))
    trees = []
    for _ in range(setting.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * 2**20) / 2**20, np.maximum(np.rint(p * (1 - p) * 2**20), 1) / 2**20
        trees.append(plain_tree(x, g, h, np.arange(len(y)), setting.tree_depth, setting, cuts))
        margin += [value(trees[-1], r) for r in x]
    return 1 / (1 + np.exp(-margin))


def table(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    x[rng.random((n, 3)) < 0.15] = math.nan
    y = ((np.nan_to_num(x[:, 0], nan=9) > 6) ^ (np.nan_to_num(x[:, 1], nan=0) > 4) ^ (rng.random(n) < 0.1)).astype(int)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, *[None if math.isnan(v) and i % 2 else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, outbreak int").repartition(parts)


@pytest.mark.parametrize("setting", [Setting(1, 1, 0.3, min_n=1), Setting(3, 3, 0.5, min_n=4), Setting(2, 2, 0.5, loss_reduction=3.0, min_n=0), Setting(2, 4, 1.0, min_n=12)])
def test_trees_against_trying_every_cut(spark, setting):
    x, y = table()
    df = frame(spark, x, y)
    model = boosting.fit(df, ["a", "b", "c"], setting)
    got = {r.id: r.pred_1 for r in boosting.predict(model, df).collect()}
    want = plain_boosting(x, y, setting, model.cuts)
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-9)


def test_trees_do_not_depend_on_partitions(spark):
    x, y = table(900, 3)
    one, many = (boosting.fit(frame(spark, x, y, n), ["a", "b", "c"], Setting(9, 2, 0.3, mtry=2, min_n=3)) for n in (1, 12))
    assert [t.packed()[4].tolist() for t in one.trees[0]] == [t.packed()[4].tolist() for t in many.trees[0]]
    assert one.passes <= 18 and len(one.trees[0]) == 9  # margins were stored on the way


def test_missing_values_go_where_they_gain(spark):
    rows = [(float(v), int(v > 5)) for v in range(10)] * 20 + [(None, 1)] * 30 + [(math.nan, 1)] * 10
    df = spark.createDataFrame(rows, "v double, outbreak int")
    model = boosting.fit(df, ["v"], Setting(1, 1, 1.0, min_n=1))
    feature, at, missing_left, left, _ = model.trees[0][0].packed()
    assert feature[0] == 0 and model.cuts[0][at[0] - 1] == 5.0 and not missing_left[0]
    flipped = boosting.fit(df.withColumn("outbreak", 1 - F.col("outbreak")).withColumn("v", -F.col("v")), ["v"], Setting(1, 1, 1.0, min_n=1))
    assert flipped.trees[0][0].packed()[2][0]


def test_cuts_are_the_values_that_reach_another_share(spark):
    rows = [(float(v),) for v in [1] * 50 + [2] * 30 + list(range(3, 23))] + [(None,), (math.nan,)]
    (cuts,) = boosting.cut_points(spark.createDataFrame(rows, "v double"), ["v"], 10).values()
    counts, want, upto = {1: 50, 2: 30} | {v: 1 for v in range(3, 23)}, [], 0
    for v, n in counts.items():
        if (upto + n) * 10 // 100 > upto * 10 // 100 and upto + n < 100:
            want.append(float(v))
        upto += n
    assert cuts == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, outbreak int")
    model = boosting.fit(empty, ["a"], Setting(2, 2))
    assert [r.pred_1 for r in boosting.predict(model, spark.createDataFrame([(1.0, 1)], "a double, outbreak int")).collect()] == [0.5]
    one_class = spark.createDataFrame([(float(i), 1, "x") for i in range(60)] + [(1.0, None, "y")], "a double, outbreak int, pred_1 string")
    got = boosting.predict(boosting.fit(one_class, ["a"], Setting(2, 2, 0.5, min_n=1)), one_class)
    assert got.columns == ["a", "outbreak", "pred_1", "pred_class"] and got.count() == 61
    assert all(r.pred_1 > 0.5 for r in got.collect())
    assert boosting.predict(model, empty).collect() == []


def study(spark, n=600):
    x, y = table(n, 5)
    start = D(2020, 1, 1)
    rows = [(f"r{i % 5}", start + dt.timedelta(days=i % 200), *[None if math.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    data = spark.createDataFrame(rows, "region string, date date, a double, b double, c double, outbreak int")
    outer = folds.outer_assignments(data, "2020-03-01", "2020-06-01", 30, 40)
    clusters = spark.createDataFrame([(f"r{i}", i % 3 + 1) for i in range(5)], "region string, cluster int")
    return data, outer, folds.inner_assignments(clusters)


def test_all_folds_together_equal_each_fold_alone(spark):
    data, outer, inner = study(spark)
    settings = [Setting(2, 2, 0.5, min_n=2), Setting(1, 3, 0.3, min_n=2)]
    models = [Model(s, a, b) for a in (1, 2, 3) for b in (1, 2, 3) for s in settings]
    scored, _ = boosting.assess_all(data, ["a", "b", "c"], models, outer, inner, keep=["region", "date"])
    got = {}
    for r in scored.collect():
        got.setdefault(r.model, []).append((r.region, r.date, r.truth, round(r.pred_1, 9)))
    cuts = boosting.cut_points(data, ["a", "b", "c"])
    for m in (0, 5, 10, 17):
        model = models[m]
        rows = folds.fold_rows(data, outer, model.outer, inner, model.inner)
        run = boosting._Run(rows.where("inner_role = 'train'"), ["a", "b", "c"], "outbreak", cuts, None, None, "", "", [])
        _, _, trees, _ = boosting._grow(run, [Model(model.setting)], 1, True)
        alone = boosting.predict(boosting.Grown([model], run.features, run.cuts, trees, 0), rows.where("inner_role = 'assess'"))
        assert sorted(got[m]) == sorted((r.region, r.date, r.outbreak, round(r.pred_1, 9)) for r in alone.collect())


def test_passes_do_not_grow_with_settings_or_folds(spark):
    data, outer, inner = study(spark, 200)
    few = [Model(Setting(2, 2, 0.5, min_n=1), 1, 1)]
    many = [Model(Setting(2, 2, 0.1 * i, loss_reduction=0.01 * i, min_n=1), a, b) for i in range(1, 7) for a in (1, 2, 3) for b in (1, 2, 3)]
    passes = [boosting.assess_all(data, ["a", "b", "c"], m, outer, inner)[1] for m in (few, many)]
    assert passes == [4, 4]


def test_tuning_chooses_and_fits(spark):
    data, outer, inner = study(spark)
    params = [{"trees": 1, "tree_depth": 1, "learn_rate": 0.3, "mtry": 3, "loss_reduction": 1e6}, {"trees": 4, "tree_depth": 3, "learn_rate": 0.5, "mtry": 3, "loss_reduction": 0.0}]
    metrics = modelling.tune_grid(data, outer, inner, params, ["a", "b", "c"], min_n=2)
    found = metrics.where("metric = 'roc_auc'").groupBy("trees").agg(F.count(F.lit(1)).alias("n"), F.avg("estimate").alias("auc")).collect()
    by_trees = {r.trees: r for r in found}
    assert by_trees[1.0].n == by_trees[4.0].n == 9 and by_trees[1.0].auc == 0.5 < by_trees[4.0].auc
    best = modelling.select_best(metrics, modelling.PARAMETERS).first()
    assert best.trees == 4.0
    got = modelling.final_fit(data, data, ["a", "b", "c"], {p: best[p] for p in modelling.PARAMETERS}, min_n=2)
    assert got.where("(pred_class = 1) = (outbreak = 1)").count() > 0.75 * got.count()


def test_kmeans_leaves_no_better_move_and_ignores_partitions(spark):
    rng = np.random.default_rng(2)
    xy = np.round(np.concatenate([rng.normal(c, 1.0, (40, 2)) for c in ((0, 0), (2, 3), (5, 0), (1, 6))]), 3)
    rows = [(f"d{i:03}", float(a), float(b)) for i, (a, b) in enumerate(xy)] + [("twin", float(xy[0, 0]), float(xy[0, 1]))]
    few, many = (folds.kmeans(spark.createDataFrame(rows, "region string, x double, y double").repartition(n), 4, 7) for n in (4, 24))
    clusters = {r.region: r.cluster for r in few[0].collect()}
    assert clusters == {r.region: r.cluster for r in many[0].collect()} and few[1] == many[1]
    points = {r[0]: np.array(r[1:]) for r in rows}
    groups = {c: [r for r in clusters if clusters[r] == c] for c in set(clusters.values())}
    assert sorted(groups) == [1, 2, 3, 4]
    centre = {c: np.mean([points[r] for r in g], axis=0) for c, g in groups.items()}
    assert all(np.allclose(centre[c], few[1][c - 1], atol=1e-5) for c in groups)
    for r, a in clusters.items():
        n = len(groups[a])
        out = n / (n - 1) * ((points[r] - centre[a]) ** 2).sum() if n > 1 else 0.0
        for b in groups:
            if b != a:
                m = len(groups[b])
                assert m / (m + 1) * ((points[r] - centre[b]) ** 2).sum() >= out - 1e-5


def test_kmeans_with_fewer_points_than_clusters(spark):
    rows = [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 5.0, 1.0)]
    clustered, centres = folds.kmeans(spark.createDataFrame(rows, "region string, x double, y double"), 4, 1)
    got = {r.region: r.cluster for r in clustered.collect()}
    assert got["a"] == got["b"] != got["c"] and sorted(centres) == [(0.0, 0.0), (5.0, 1.0)]
    empty, none = folds.kmeans(spark.createDataFrame([], "region string, x double, y double"), 4, 1)
    assert empty.collect() == [] and none == []


def test_fold_labels(spark):
    data = spark.createDataFrame([(D(2004, 12, 31),), (D(2006, 1, 1),)], "date date")
    got = folds.fold_labels(folds.outer_folds(spark, "2005-04-07", "2005-08-01"), data).collect()
    assert [(r.train_range, r.assess_range) for r in got] == [("2004-12-31 2005-04-07", "2005-04-08 2005-07-06"), ("2004-12-31 2005-07-06", "2005-07-07 2005-10-04")]


def test_rolling_origin_bounds_of_rows(spark):
    data = spark.createDataFrame([(i, i % 3) for i in range(57)], "o int, z int").repartition(4)
    got = {r.o: r for r in folds.rolling_origin_rows(data, ["o"], 10, 7, 4).collect()}
    stops = [10 + 5 * i for i in range(20) if 10 + 5 * i + 7 <= 57]
    for o, r in got.items():
        trains = [f for f, s in enumerate(stops, 1) if o + 1 <= s]
        assesses = [f for f, s in enumerate(stops, 1) if s < o + 1 <= s + 7]
        assert r.trains_from == (trains[0] if trains else None)
        assert (list(range(r.assess_from, r.assess_to + 1)) if r.assess_from else []) == assesses
    assert len(got) == 57
    none = folds.rolling_origin_rows(data.limit(5), ["o"], 10, 7, 4).collect()
    assert len(none) == 5 and {(r.trains_from, r.assess_from) for r in none} == {(None, None)}
