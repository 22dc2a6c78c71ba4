"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text and an estimated class prior.

Labels of bad text are not used.  With the share ``p`` of good text among the unlabelled, the risk on bad text is that of
the unlabelled as bad less ``p`` times that of the positives as bad.  On a sample this difference can fall below zero,
which no true risk does, and then a flexible model only learns its sample by heart; so wherever it does on a mini-batch,
the step is taken back instead (non-negative risk).

``p`` is estimated from the same two samples.  Halves of them train a plain model of positives against unlabelled; on the
other halves, the share of unlabelled above a score is at least ``p`` times the share of positives above it, with
equality where bad text no longer reaches.  The least ratio over all scores, with a margin for the sample size, is ``p``.
A model of non-negative risk with this ``p``, on the same halves, parts good from bad better and gives the final ``p``.

Features of a whole text are shares of neighbouring byte classes (letters by case, digits, blanks, line ends, every ASCII
sign by itself, other bytes), statistics of its words and lines, and hashed words.  The model is linear and fitted in one
task on at most ``POSITIVES`` and ``UNLABELLED`` rows; its weights, 70 KB, are broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import SIGNS, text_slices, words

POSITIVES, UNLABELLED = 8_000, 16_000  # rows the model is fitted on, at most; taken by hashes of the id and the text
WORD_BITS = 14  # hashed words
TEXTS, STRETCH = 512, 1 << 20  # texts that are counted together, and bytes at a time
STEPS, RATE, DECAY = 1_500, 0.05, 1e-5
BATCH_POSITIVES, BATCH_UNLABELLED = 256, 512
MARGIN = 0.05  # confidence of the prior's margin

_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = 5
for _c, _span in enumerate(("az", "AZ", "09")):
    _CLASS[ord(_span[0]) : ord(_span[1]) + 1] = _c
_CLASS[0x20], _CLASS[[0x0A, 0x0D]] = 3, 4
_ASCII_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_ASCII_SIGNS] = np.arange(7, 7 + len(_ASCII_SIGNS))
CLASSES = 7 + len(_ASCII_SIGNS)
PAIRS, STATISTICS = CLASSES * CLASSES, 8
SIZE = PAIRS + STATISTICS + (1 << WORD_BITS)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    prior: float = 0.0
    positives: int = 0  # rows it was fitted on
    unlabelled: int = 0


def _group(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense columns (pairs and statistics) of some texts, and their hashed words as text, word, value."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    pairs, capitals, lines = np.zeros(n * PAIRS, np.int64), np.zeros(n), np.zeros(n)
    for a in range(0, len(data), STRETCH):  # a pair belongs to the stretch of its second byte
        b = min(len(data), a + STRETCH)
        kind = _CLASS[data[max(a - 1, 0) : b]].astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(max(a - 1, 0), b), side="right") - 1
        same = doc[1:] == doc[:-1]
        pairs += np.bincount((doc[1:] * PAIRS + kind[1:] + CLASSES * kind[:-1])[same], minlength=n * PAIRS)
        here = slice(min(a, 1), None)
        capitals += np.bincount(doc[here], kind[here] == 1, n)
        lines += np.bincount(doc[here], kind[here] == 4, n)
    dense = np.zeros((n, PAIRS + STATISTICS))
    dense[:, :PAIRS] = np.sqrt(pairs.reshape(n, PAIRS) / np.maximum(length - 1, 1)[:, None])

    w = words(data, offsets, SIGNS, lower=True)
    owner = w.doc()
    total = np.maximum(np.diff(w.first), 1).astype(float)
    order = np.lexsort((w.code, owner))
    o, c = owner[order], w.code[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (c[1:] != c[:-1]))) if len(o) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(o)))
    text, code = o[first], c[first]
    commonest = np.zeros(n)
    np.maximum.at(commonest, text, count)
    letters = np.bincount(owner, w.end - w.start, n)
    most = np.maximum(length, 1)
    columns = [np.bincount(text, minlength=n) / total, commonest / total, letters / total / 16, letters / most, capitals / most, lines / total, np.log1p(length) / 12, np.log1p(total) / 10]
    dense[:, PAIRS:] = np.stack(columns, axis=1)
    return dense, text, (code >> np.uint64(64 - WORD_BITS)).astype(np.int64), np.sqrt(count / total[text])


def _groups(texts: pa.Array) -> Iterator[tuple]:
    for _, _, data, offsets in text_slices(texts):
        for a in range(0, len(offsets) - 1, TEXTS):
            part = offsets[a : a + TEXTS + 1]
            yield _group(data[part[0] : part[-1]], part - part[0])


class Sample:
    """Rows of sparse features, one after another."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.first = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows], dtype=np.int64)]).astype(np.int64)
        self.at = np.concatenate([*[i for i, _ in rows], np.zeros(0, np.uint32)]).astype(np.int64)
        self.value = np.concatenate([*[v for _, v in rows], np.zeros(0, np.float32)]).astype(np.float64)

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = self.first[rows + 1] - self.first[rows]
        owner = np.repeat(np.arange(len(rows)), length)
        at = np.arange(len(owner)) + np.repeat(self.first[rows] - np.cumsum(length) + length, length)
        return owner, self.at[at], self.value[at]

    def margins(self, rows: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        owner, at, value = self.take(rows)
        return np.bincount(owner, weights[at] * value, len(rows)) + bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(positives: Sample, unlabelled: Sample, prior: float | None, seed: int = 13, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by Adam on mini-batches.

    The loss is the sigmoid: it is bounded, so the many good texts among the unlabelled cannot outweigh the bad ones by
    lying far on the good side.  Without a prior, positives and unlabelled are told apart by plain logistic loss.
    """
    draw = np.random.default_rng(seed)
    x, m, v = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for step in range(1, steps + 1):
        p = draw.integers(0, len(positives), BATCH_POSITIVES)
        u = draw.integers(0, len(unlabelled), BATCH_UNLABELLED)
        (po, pa_, pv), (uo, ua, uv) = positives.take(p), unlabelled.take(u)
        gp = np.bincount(po, x[pa_] * pv, len(p)) + x[-1]
        gu = np.bincount(uo, x[ua] * uv, len(u)) + x[-1]
        sp, su = _sigmoid(gp), _sigmoid(gu)
        if prior is None:
            dp, du = (sp - 1.0) / len(p), su / len(u)
        else:
            as_bad, others = sp * (1.0 - sp) / len(p), su * (1.0 - su) / len(u)  # slopes of each text's loss as a bad one
            if su.mean() >= prior * sp.mean():
                dp, du = -2.0 * prior * as_bad, others
            else:  # the risk on bad text is below zero; take that part back
                dp, du = prior * as_bad, -others
        slope = np.bincount(pa_, dp[po] * pv, SIZE + 1) + np.bincount(ua, du[uo] * uv, SIZE + 1) + DECAY * x
        slope[-1] = dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        rate = RATE * min(1.0, 2.0 * (1.0 - step / (steps + 1)))
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


def estimated_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, margin: float = MARGIN) -> float:
    """The least share of unlabelled above a score by that of positives above it, both taken with their margins."""
    if not len(positive_scores) or not len(unlabelled_scores):
        return 0.5
    p, u = np.sort(positive_scores), np.sort(unlabelled_scores)
    at = np.unique(p)
    above_p = 1.0 - np.searchsorted(p, at) / len(p)
    above_u = 1.0 - np.searchsorted(u, at) / len(u)
    slip = np.sqrt(np.log(4.0 / margin) / 2.0) * (1.0 / np.sqrt(len(p)) + 1.0 / np.sqrt(len(u)))
    best = int(np.argmin((above_u + slip) / above_p))  # the bound decides where, the ratio there is the estimate
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def learn(positives: Sample, unlabelled: Sample, seed: int = 13) -> Model:
    """Estimate the prior on halves, then fit on everything.  Without positives or unlabelled rows, score one half."""
    if not len(positives) or not len(unlabelled):
        return Model(0.0, np.zeros(SIZE), 0.5, len(positives), len(unlabelled))
    halves = [(np.arange(0, len(s), 2), np.arange(1, len(s), 2) if len(s) > 1 else np.arange(1)) for s in (positives, unlabelled)]
    half = [_some(s, h[0]) for s, h in zip((positives, unlabelled), halves)]
    prior = None
    for _ in range(2):
        weights, bias = fit(*half, prior, seed, STEPS // 2)
        prior = estimated_prior(positives.margins(halves[0][1], weights, bias), unlabelled.margins(halves[1][1], weights, bias))
    weights, bias = fit(positives, unlabelled, prior, seed)
    return Model(bias, weights, prior, len(positives), len(unlabelled))


def _some(sample: Sample, rows: np.ndarray) -> Sample:
    return Sample([(sample.at[a:b], sample.value[a:b]) for a, b in zip(sample.first[rows], sample.first[rows + 1])])


def sparse(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of every text as places and values."""
    for dense, owner, word, value in _groups(texts):
        edge = np.searchsorted(owner, np.arange(len(dense) + 1))
        for d, row in enumerate(dense):
            used = np.flatnonzero(row)
            here = slice(edge[d], edge[d + 1])
            yield np.concatenate([used, PAIRS + STATISTICS + word[here]]).astype("<u4"), np.concatenate([row[used], value[here]]).astype("<f4")


def train(
    documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, key: str = "doc_id", text: str = "text"
) -> Model:
    """Fit on a bounded sample of ``documents``: those that ``labels`` (``key, quality``) calls good, and any.

    Only rows whose every label is 1 are trusted; other labels are not looked at.  Rows that repeat a key and text count
    once.  The bounds hold after labels have met documents, so labels without a document take no room.  Rows without a
    key are unlabelled; null and empty texts are rows like any other.
    """
    trusted = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("_least")).where("_least = 1").select(key)
    known = documents.select(F.col(key), F.col(text), F.xxhash64(text).alias("_hash"))
    names = known.select(key, "_hash").distinct()
    # Copies of a key follow each other in the order, and the bound is on rows.
    good = names.join(trusted, key, "left_semi").withColumn("_order", F.xxhash64(F.lit(13), key, "_hash")).orderBy("_order", key, "_hash").limit(positives)
    any_ = names.withColumn("_order", F.xxhash64(F.lit(31), key, "_hash")).orderBy("_order", key, "_hash").limit(unlabelled)
    either = good.select(key, "_hash", "_order", F.lit(1).alias("good")).unionByName(any_.select(key, "_hash", "_order", F.lit(0).alias("good")))
    either = either.withColumnsRenamed({key: "_key", "_hash": "_same"})  # at most both bounds of rows
    rows = known.join(F.broadcast(either), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_same")))
    rows = rows.dropDuplicates(["_key", "_same", "good"]).select(text, "good", "_order", F.col("_key").cast("string").alias("id"), "_same")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sparse(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), *batch.columns[1:]],
                names=["places", "shares", "good", "order", "id", "same"],
            )

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending"), ("same", "ascending")])
        flag = table.column("good").to_numpy() == 1
        places, shares = table.column("places"), table.column("shares")
        part = [Sample([(np.frombuffer(places[i].as_py(), "<u4"), np.frombuffer(shares[i].as_py(), "<f4")) for i in np.flatnonzero(f)]) for f in (flag, ~flag)]
        m = learn(*part)
        return pa.table({"bias": [m.bias], "weights": pa.array([m.weights.astype("<f8").tobytes()], pa.binary()), "prior": [m.prior], "positives": [m.positives], "unlabelled": [m.unlabelled]})

    features = rows.mapInArrow(coded, "places binary, shares binary, good int, order long, id string, same long")
    got = features.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(one, "bias double, weights binary, prior double, positives long, unlabelled long").first()
    if got is None:
        return Model(0.0, np.zeros(SIZE), 0.5)
    return Model(got["bias"], np.frombuffer(got["weights"], "<f8"), got["prior"], got["positives"], got["unlabelled"])


def score(documents: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``: how likely the whole text is good.  A null or empty text scores by its bias and length alone.

    An input column of that name is replaced; other columns travel along unread.
    """
    kept = [c for c in documents.columns if c != into]
    place = kept.index(text)
    shared = documents.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for dense, owner, word, value in _groups(batch.column(place)):
                margin = dense @ weights[: PAIRS + STATISTICS] + np.bincount(owner, weights[PAIRS + STATISTICS + word] * value, len(dense))
                out.append(_sigmoid(margin + bias))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(np.concatenate(out))], names=[*kept, into])

    return documents.select(*kept).mapInArrow(task, T.StructType([*[documents.schema[c] for c in kept], T.StructField(into, T.DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    """A third of all documents, by checksum of the id; their labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``documents``."""
    narrow = documents.select("doc_id", "text")
    model = train(narrow.where(~held_out()), labels.select("doc_id", "quality").where(~held_out()))
    return score(narrow, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
