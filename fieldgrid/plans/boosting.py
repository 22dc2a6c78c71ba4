"""Second-order gradient boosting of many models in shared passes.

A model is a fold (rows by date and by district) with a setting.  All models grow their next level in the same pass over
the data: tasks add up gradients and hessians by (model, node, feature, bin), Spark sums them, and the best split of
every node is a window over its bins and one aggregate.  So the number of passes is that of the deepest and longest
setting, whatever the number of settings and folds.

Rules, those of second-order boosting with a logistic loss:

* gain of a split = GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda); it is made when that is above
  ``loss_reduction`` and each child has at least ``min_n`` of hessian;
* rows without the value (NULL or NaN) go to the side that gains more, to the right if both gain alike;
* a leaf adds -learn_rate * G / (H + lambda) to the margin; margins start at zero;
* of equal gains the lower feature, then the lower bin wins.

Features are cut at quantiles of the values that occur, once for all models.  Gradients and hessians are rounded to
2**-20, so sums are integers: trees do not depend on how rows are dealt to tasks.  Margins are stored beside the rows
every few trees; in between, tasks follow the trees grown since.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import running_totals
from ..session import Stored, calendar_side

BINS = 64  # of a feature; one more holds missing values
LAMBDA = 1.0
UNIT = float(1 << 20)  # gradients and hessians are counted in parts of one by this
LEAST_GAIN = 1e-6
STORE_EVERY = 8  # trees between two writes of the margins
CELLS = 4 << 20  # histogram cells that a task holds before it sends them on
MODELS = 512  # models that are grown together; margins take 8 bytes for each beside every row


@dataclass(frozen=True)
class Setting:
    trees: int = 20
    tree_depth: int = 5
    learn_rate: float = 0.1
    mtry: int = 0  # features tried at a node; 0: all
    loss_reduction: float = 0.0
    min_n: float = 12.0


@dataclass(frozen=True)
class Model:
    """What to fit: a setting on the rows that train fold ``outer`` and, with an inner fold, train that too."""

    setting: Setting
    outer: int | None = None
    inner: int | None = None


@dataclass
class Tree:
    """Nodes by position; the right child follows the left.  ``feature`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool, left: float, right: float) -> int:
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node] = feature, at, missing_left, len(self.feature)
        for value in (left, right):
            for column, new in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.value, value)):
                column.append(new)
        return self.left[node]

    def packed(self) -> tuple:
        return (np.array(self.feature), np.array(self.bin), np.array(self.missing_left), np.array(self.left), np.array(self.value))


def _leaves(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node each row ends in."""
    feature, at, missing_left, left, _ = tree
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        b = bins[rows, np.maximum(f, 0)]
        goes_left = np.where(b == 0, missing_left[node], b <= at[node])
        node = np.where(inner, left[node] + ~goes_left, node)


def cut_points(data: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Values to cut each feature at: those in which another ``1/bins`` of the values that are there is reached.

    The order runs over ranges, not through one task; at most ``bins`` values of a feature come back.  The largest
    value is no cut.  NULL and NaN are missing.
    """
    columns = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    counts = data.select(F.explode(columns).alias("_f")).select("_f.*").where("value IS NOT NULL AND NOT isnan(value)").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = running_totals(counts, ["value"], {"upto": "n"}, ["feature"])
    totals = steps.groupBy("feature").agg(F.max("upto").alias("total"))  # a row a feature
    part = lambda c: F.floor(c * bins / F.col("total"))
    steps = steps.join(F.broadcast(totals), "feature").where(F.col("upto") < F.col("total"))
    found = steps.where(part(F.col("upto")) > part(F.col("upto") - F.col("n"))).select("feature", "value").collect()
    out: dict[str, list[float]] = {f: [] for f in features}
    for r in found:
        out[features[r["feature"]]].append(r["value"])
    return {f: sorted(v) for f, v in out.items()}


def _binned(columns: Sequence[pa.Array], cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of every value: 0 if missing, else one more than the cuts below it."""
    kind = np.uint8 if max(map(len, cuts), default=0) < 255 else np.uint16
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), kind)
    for i, (column, edges) in enumerate(zip(columns, cuts)):
        x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(np.array(edges, float), x, side="left") + 1)
    return out


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def _roles(column: pa.Array, count: int) -> np.ndarray:
    """Lists of fold numbers as a table of yes and no; fold ``f`` is column ``f - 1``."""
    out = np.zeros((len(column), count), bool)
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    edge = column.offsets.to_numpy()
    numbers = column.values.to_numpy(zero_copy_only=False)[edge[0] : edge[-1]]
    out[rows, numbers.astype(np.int64) - 1] = True
    return out


class _Batch:
    """Rows of one Arrow batch: bins, labels, which folds they train and assess, margins so far."""

    def __init__(self, batch: pa.RecordBatch, width: int, kind: str, models: int, n_outer: int, n_inner: int):
        n = batch.num_rows
        column = {c: batch.column(c) for c in batch.schema.names}
        self.bins = np.frombuffer(b"".join(column["_bins"].to_pylist()), kind).reshape(n, width)
        self.y = column["_y"].to_numpy(zero_copy_only=False).astype(np.float64)
        self.folds = {c: _roles(column[c], k) for c, k in (("_trains", n_outer), ("_inner_trains", n_inner), ("_inner_assesses", n_inner))}
        self.assesses = _roles(column["_assesses"], n_outer)
        raw = column.get("_margins")
        self.margins = np.zeros((n, models)) if raw is None else np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(n, models).copy()

    def rows(self, model: Model, assess: bool = False) -> np.ndarray:
        """Rows that train the model; with ``assess``, those it is judged on."""
        n = len(self.y)
        if model.outer is None:
            return np.arange(n) if not assess else np.zeros(0, np.int64)
        if model.inner is None:
            return np.flatnonzero((self.assesses if assess else self.folds["_trains"])[:, model.outer - 1])
        inner = self.folds["_inner_assesses" if assess else "_inner_trains"][:, model.inner - 1]
        return np.flatnonzero(self.folds["_trains"][:, model.outer - 1] & inner)

    def add(self, pending: list[dict[int, tuple]]) -> None:
        for trees in pending:
            for m, tree in trees.items():
                self.margins[:, m] += tree[4][_leaves(tree, self.bins)]


@dataclass
class Grown:
    """Fitted models and, if wanted, their trees; ``state`` holds rows with the margins of all models."""

    models: list[Model]
    features: list[str]
    cuts: list[list[float]]
    trees: list[list[Tree]]
    passes: int  # over the data


def _fold_lists(folds: DataFrame, key: str, number: str, role: str, trains: str, assesses: str) -> tuple[DataFrame, int]:
    """One row a date or district with the folds it trains and those it assesses, and the highest fold number."""
    pick = lambda r: F.collect_list(F.when(F.col(role) == r, F.col(number).cast("int")))
    lists = folds.groupBy(key).agg(pick("train").alias(trains), pick("assess").alias(assesses))
    return calendar_side(lists), folds.agg(F.max(number)).first()[0] or 0


class _Run:
    """Rows in bins, and passes over them for a list of models."""

    def __init__(self, data: DataFrame, features: Sequence[str], label: str, cuts: dict[str, list[float]], outer: DataFrame | None, inner: DataFrame | None, region: str, date: str, keep: Sequence[str]):
        self.features, self.cuts = list(features), [cuts[f] for f in features]
        self.keep = list(keep)
        none = F.array().cast("array<int>")
        rows = data.where(F.col(label).isNotNull())
        self.n_outer = self.n_inner = 0
        if outer is not None:
            by_date, self.n_outer = _fold_lists(outer, date, "fold_id", "role", "_trains", "_assesses")
            rows = rows.join(by_date, date, "left")
        if inner is not None:
            by_region, self.n_inner = _fold_lists(inner, region, "inner_fold", "inner_role", "_inner_trains", "_inner_assesses")
            rows = rows.join(by_region, region, "left")
        fold_columns = ("_trains", "_assesses", "_inner_trains", "_inner_assesses")
        rows = rows.select(
            *[F.col(c) for c in self.keep],
            F.col(label).cast("double").alias("_y"),
            *[(F.coalesce(F.col(c), none) if c in rows.columns else none).alias(c) for c in fold_columns],
            *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)],
        )
        width, edges, kept = len(self.features), self.cuts, [*self.keep, "_y", *fold_columns]
        self.kind = "u1" if max(map(len, edges), default=0) < 255 else "<u2"

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _binned([batch.column(f"_x{i}") for i in range(width)], edges)
                raw = pa.array([row.tobytes() for row in bins] if width else [b""] * batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], raw], names=[*kept, "_bins"])

        schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("_bins", T.BinaryType())])
        self.table = Stored(data.sparkSession, "boosting")
        self.base = self.table.put(rows.mapInArrow(binned, schema), "rows")

    def _read(self, models: int):
        width, kind, outer, inner = len(self.features), self.kind, self.n_outer, self.n_inner
        return lambda batch: _Batch(batch, width, kind, models, outer, inner)

    def sums(self, state: DataFrame, models: list[Model], pending: list, growing: dict[int, tuple]) -> DataFrame:
        """``model, node, feature, bin, g, h`` for the open nodes of ``growing``: model -> (tree, place of each open node,
        features tried at it)."""
        read, width = self._read(len(models)), len(self.features)
        depth = max(map(len, self.cuts), default=0) + 2
        sent = state.sparkSession.sparkContext.broadcast((models, pending, growing))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, pending, growing = sent.value
            held: dict[int, np.ndarray] = {}

            def send() -> Iterator[pa.RecordBatch]:
                for m, cells in held.items():
                    _, slots, tried = growing[m]
                    node_of = np.flatnonzero(slots >= 0)[np.argsort(slots[slots >= 0])]
                    place = np.flatnonzero(cells[1])
                    slot, rest = np.divmod(place, width * depth)
                    feature, at = np.divmod(rest, depth)
                    use = tried[slot, feature]
                    columns = [np.full(use.sum(), m), node_of[slot[use]], feature[use], at[use], *cells[:, place[use]].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["model", "node", "feature", "bin", "g", "h"])
                held.clear()

            for batch in batches:
                b = read(batch)
                b.add(pending)
                offset = np.arange(width) * depth
                for m, (tree, slots, _) in growing.items():
                    rows = b.rows(models[m])
                    bins = b.bins[rows]
                    slot = slots[_leaves(tree, bins)]
                    rows, bins, slot = rows[slot >= 0], bins[slot >= 0], slot[slot >= 0]
                    if not len(rows):
                        continue
                    p = _sigmoid(b.margins[rows, m])
                    g, h = np.rint((p - b.y[rows]) * UNIT), np.maximum(np.rint(p * (1.0 - p) * UNIT), 1.0)
                    cell = (slot[:, None] * (width * depth) + offset + bins).ravel()
                    size = (int(slots.max()) + 1) * width * depth
                    if m not in held:
                        if sum(x.shape[1] for x in held.values()) + size > CELLS:
                            yield from send()
                        held[m] = np.zeros((2, size))
                    for i, w in enumerate((g, h)):  # sums of integers, exact in doubles
                        held[m][i] += np.bincount(cell, np.repeat(w, width), size)
            yield from send()

        return state.mapInArrow(task, "model long, node long, feature long, bin long, g long, h long")

    def stored(self, state: DataFrame, models: list[Model], pending: list, name: str) -> DataFrame:
        """The rows with their margins up to now."""
        read = self._read(len(models))
        sent = state.sparkSession.sparkContext.broadcast(pending)
        kept = [c for c in state.columns if c != "_margins"]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = read(batch)
                b.add(sent.value)
                raw = pa.array([row.tobytes() for row in b.margins.astype("<f8")], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], raw], names=[*kept, "_margins"])

        schema = T.StructType([*[state.schema[c] for c in kept], T.StructField("_margins", T.BinaryType())])
        return self.table.put(state.mapInArrow(task, schema), name)

    def scores(self, state: DataFrame, models: list[Model], pending: list) -> DataFrame:
        """``model, <kept columns>, truth, pred_1`` of the rows that each model is judged on."""
        read, keep = self._read(len(models)), self.keep
        sent = state.sparkSession.sparkContext.broadcast((models, pending))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, pending = sent.value
            for batch in batches:
                b = read(batch)
                b.add(pending)
                for m, model in enumerate(models):
                    rows = b.rows(model, assess=True)
                    if len(rows):
                        mine = [batch.column(c).take(pa.array(rows)) for c in keep]
                        columns = [pa.array(np.full(len(rows), m), pa.int64()), *mine, pa.array(b.y[rows].astype(np.int32)), pa.array(_sigmoid(b.margins[rows, m]))]
                        yield pa.RecordBatch.from_arrays(columns, names=["model", *keep, "truth", "pred_1"])

        fields = [T.StructField("model", T.LongType()), *[state.schema[c] for c in keep], T.StructField("truth", T.IntegerType()), T.StructField("pred_1", T.DoubleType())]
        return state.mapInArrow(task, T.StructType(fields))


def best_splits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """``model, node, g, h`` of every node and its best split, if one is allowed: ``feature, bin, missing_left``, sums of
    both children.

    ``limits`` has ``model, loss_reduction, min_n``.  A window holds the bins of one feature of one node.
    """
    keys = ["model", "node", "feature"]
    cells = sums.groupBy(*keys, "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    unit = F.lit(UNIT)
    cells = cells.select(
        *keys,
        "bin",
        *[(F.sum(c).over(whole) / unit).alias(f"{c}_all") for c in "gh"],
        *[(F.sum(c).over(upto) / unit).alias(f"{c}_upto") for c in "gh"],
        *[(F.sum(F.when(F.col("bin") == 0, F.col(c)).otherwise(0)).over(whole) / unit).alias(f"{c}_missing") for c in "gh"],
    )
    part = lambda g, h: g * g / (h + F.lit(LAMBDA))
    sides = F.array(
        *[
            F.struct(
                F.lit(left).alias("missing_left"),
                (F.col("g_upto") - (F.lit(0.0) if left else F.col("g_missing"))).alias("gl"),
                (F.col("h_upto") - (F.lit(0.0) if left else F.col("h_missing"))).alias("hl"),
            )
            for left in (False, True)
        ]
    )
    tried = cells.select("*", F.inline(sides)).withColumns({"gr": F.col("g_all") - F.col("gl"), "hr": F.col("h_all") - F.col("hl")})
    gain = (part(F.col("gl"), F.col("hl")) + part(F.col("gr"), F.col("hr"))) - part(F.col("g_all"), F.col("h_all"))
    tried = tried.join(F.broadcast(limits), "model").withColumn("gain", gain)
    allowed = (
        (F.col("bin") > 0)
        & (F.least("hl", "hr") > 0)
        & (F.least("hl", "hr") >= F.col("min_n"))
        & (F.col("gain") > F.greatest(F.col("loss_reduction"), F.lit(LEAST_GAIN)))
    )
    choice = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("right"), "gl", "hl", "gr", "hr")
    best = tried.groupBy("model", "node").agg(F.max(F.when(allowed, choice)).alias("s"), F.max(F.struct("g_all", "h_all")).alias("all"))
    return best.select(
        "model", "node", F.col("all.g_all").alias("g"), F.col("all.h_all").alias("h"),
        (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), (~F.col("s.right")).alias("missing_left"),
        F.col("s.gain").alias("gain"), *[F.col(f"s.{c}").alias(c) for c in ("gl", "hl", "gr", "hr")],
    )


def _grow(run: _Run, models: list[Model], seed: int, keep_trees: bool) -> tuple[DataFrame, list, list[list[Tree]], int]:
    """All trees of all models.  Returns the rows with margins, trees not yet in them, the trees, and the passes."""
    spark = run.base.sparkSession
    limits = spark.createDataFrame(
        [(m, float(x.setting.loss_reduction), float(x.setting.min_n)) for m, x in enumerate(models)], "model long, loss_reduction double, min_n double"
    )
    state, stored, pending, passes = run.base, None, [], 0
    kept: list[list[Tree]] = [[] for _ in models]
    width = len(run.features)
    for number in range(max((m.setting.trees for m in models), default=0)):
        trees = {m: Tree() for m, x in enumerate(models) if x.setting.trees > number}
        open_nodes = {m: [0] for m in trees}
        for level in range(max((models[m].setting.tree_depth for m in trees), default=0)):
            growing = {}
            for m, nodes in open_nodes.items():
                if not nodes or level >= models[m].setting.tree_depth:
                    continue
                slots = np.full(len(trees[m].feature), -1)
                slots[nodes] = np.arange(len(nodes))
                tried = np.ones((len(nodes), width), bool)
                few = models[m].setting.mtry
                if 0 < few < width:  # drawn by setting, tree and node, not by fold
                    for i, node in enumerate(nodes):
                        tried[i] = False
                        tried[i, np.random.default_rng([seed, number, node, few]).permutation(width)[:few]] = True
                growing[m] = (trees[m].packed(), slots, tried)
            if not growing:
                break
            passes += 1
            found = best_splits(run.sums(state, models, pending, growing), limits).collect()  # a row for each open node
            open_nodes = {m: [] for m in growing}
            for r in sorted(found, key=lambda r: (r["model"], r["node"])):
                m, rate = r["model"], models[r["model"]].setting.learn_rate
                leaf = lambda g, h: -rate * (g / (h + LAMBDA))  # noqa: E731, B023
                if level == 0:
                    trees[m].value[0] = leaf(r["g"], r["h"])
                if r["feature"] is not None:
                    left = trees[m].split(r["node"], r["feature"], r["bin"], r["missing_left"], leaf(r["gl"], r["hl"]), leaf(r["gr"], r["hr"]))
                    open_nodes[m] += [left, left + 1]
        for m, tree in trees.items():
            if keep_trees:
                kept[m].append(tree)
        pending.append({m: tree.packed() for m, tree in trees.items()})
        if len(pending) == STORE_EVERY:
            state = run.stored(state, models, pending, f"margins-{number}")
            if stored:
                run.table.drop(stored)
            stored, pending = f"margins-{number}", []
    return state, pending, kept, passes


def fit(
    data: DataFrame, features: Sequence[str], setting: Setting, label: str = "outbreak", bins: int = BINS, seed: int = 1
) -> Grown:
    """One model on all rows that have a label."""
    run = _Run(data, features, label, cut_points(data, features, bins), None, None, "", "", [])
    models = [Model(setting)]
    _, _, trees, passes = _grow(run, models, seed, True)
    run.table.drop("rows")
    return Grown(models, run.features, run.cuts, trees, passes)


def predict(grown: Grown, data: DataFrame, model: int = 0) -> DataFrame:
    """Probability of class 1 as ``pred_1`` and the class as ``pred_class``, beside all columns of ``data``."""
    kept = [c for c in data.columns if c not in ("pred_1", "pred_class")]
    packed = data.sparkSession.sparkContext.broadcast(([t.packed() for t in grown.trees[model]], grown.cuts))
    names = [f"_x{i}" for i in range(len(grown.features))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cuts = packed.value
        for batch in batches:
            margin = np.zeros(batch.num_rows)
            if names:
                bins = _binned([batch.column(n) for n in names], cuts)
                for tree in trees:
                    margin += tree[4][_leaves(tree, bins)]
            else:
                margin += sum(tree[4][0] for tree in trees)
            p = _sigmoid(margin)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "pred_1", "pred_class"])

    rows = data.select(*kept, *[F.col(f).cast("double").alias(n) for f, n in zip(grown.features, names)])
    schema = T.StructType([*[data.schema[c] for c in kept], T.StructField("pred_1", T.DoubleType()), T.StructField("pred_class", T.IntegerType())])
    return rows.mapInArrow(task, schema)


def assess_all(
    data: DataFrame,
    features: Sequence[str],
    models: Sequence[Model],
    outer: DataFrame,
    inner: DataFrame | None = None,
    label: str = "outbreak",
    region: str = "region",
    date: str = "date",
    bins: int = BINS,
    seed: int = 1,
    models_at_once: int = MODELS,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, int]:
    """``model, truth, pred_1`` of every row that each model is judged on, and the number of passes over the data.

    ``outer`` has ``date, fold_id, role``, ``inner`` has ``region, inner_fold, inner_role``.  A model with an inner fold
    trains and is judged within the training rows of its outer fold.  Up to ``models_at_once`` models share all passes.
    """
    run = _Run(data, features, label, cut_points(data, features, bins), outer, inner, region, date, keep)
    models, out, passes = list(models), None, 0
    for begin in range(0, max(len(models), 1), models_at_once):
        part = models[begin : begin + models_at_once]
        state, pending, _, n = _grow(run, part, seed, False)
        scored = run.scores(state, part, pending).withColumn("model", F.col("model") + begin)
        out, passes = run.table.put(scored, "scores", append=True), passes + n
    return out, passes
