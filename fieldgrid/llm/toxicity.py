"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, pairs of neighbours and pairs with one word between, A-Z as a-z, and words cut to their
first bytes as stems, so that endings do not hide a word.  Each is hashed to 32 bits and counted once per text.  The model is fitted on at most ``SAMPLE`` labelled rows, in one task of bounded size; per-
coordinate rates let rare features move fast, and the L1 term leaves only those that tell, so the weights are a short
sorted table that is broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import SIGNS, Words, mix, text_slices, words

SAMPLE = 8_000  # labelled rows the model is fitted on, at most; taken by hashes of the id and the text
STEMS = (4, 5, 6)  # bytes of a longer word that count as a word of their own
MIN_ROWS = 3  # rows of the sample a feature must occur in
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 5.0, 0.0, 6

_NEIGHBOUR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass
class Model:
    bias: float
    features: np.ndarray  # sorted
    weights: np.ndarray
    rows: int = 0  # it was fitted on


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts and the text each belongs to; repeats are still in."""
    doc = w.doc()
    parts, owners = [w.code], [doc]
    for gap, seed in ((1, _NEIGHBOUR), (2, _SKIP)):
        same = np.flatnonzero(doc[:-gap] == doc[gap:]) if len(doc) > gap else np.zeros(0, np.int64)
        parts.append(mix(w.code[same] * seed + w.code[same + gap]))
        owners.append(doc[same])
    for k in STEMS:
        longer = np.flatnonzero(w.end - w.start > k)
        parts.append(mix(w.span_codes(w.start[longer], w.start[longer] + k) + np.uint64(k)))
        owners.append(doc[longer])
    return (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32), np.concatenate(owners)


def _distinct(found: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | found)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """FTRL-proximal over the rows in the given order, ``PASSES`` times."""
    known, count = np.unique(np.concatenate([*rows, np.zeros(0, np.uint32)]), return_counts=True)
    known = known[count >= MIN_ROWS]
    places = []
    for r in rows:
        at = np.searchsorted(known, r)
        at = at[at < len(known)] if len(known) else at[:0]
        r = r[: len(at)]  # rows are sorted, so those beyond the table are last
        places.append(np.append(at[known[at] == r], len(known)))  # the last coordinate is the bias
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    penalty = np.full(len(known) + 1, L1)
    penalty[-1] = 0.0

    def weights(at):
        zi, l1 = z[at], penalty[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for at, y in zip(places, labels):
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(len(known) + 1))
    used = np.flatnonzero(w[:-1])
    return Model(float(w[-1]), known[used], w[used], len(rows))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """``labels`` has ``key, toxic``.  Rows without a key, a label or a document are left out.

    Rows that repeat a key and text count once, and the bound is on rows: a key with many texts brings no more.

    Without any labelled row the model is neutral: every score is one half.
    """
    labelled = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("_label"))
    known = documents.select(F.col(key), F.col(text), F.xxhash64(text).alias("_text"))
    met = known.select(key, "_text").where(F.col(key).isNotNull()).distinct().join(labelled, key)  # labels without a document take no room
    least = met.withColumn("_order", F.xxhash64(F.lit(5), F.col(key))).orderBy("_order", key, "_text").limit(sample)
    rows = known.join(F.broadcast(least), [key, "_text"]).dropDuplicates([key, "_text"])  # at most ``sample`` rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in text_slices(batch.column(0)):
                found, doc = _distinct(*features(words(data, offsets, SIGNS, lower=True)))
                edge = np.searchsorted(doc, np.arange(len(offsets)))
                out += [found[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], names=["found", "label", "order", "id", "text"])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending"), ("text", "ascending")])
        found = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("found")]  # views, no copies
        m = fit(found, table.column("label").to_numpy())
        binary = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"bias": [m.bias], "features": binary(m.features), "weights": binary(m.weights), "rows": [m.rows]})

    coded = rows.select(text, F.col("_label").cast("double"), "_order", F.col(key).cast("string"), "_text").mapInArrow(
        task, "found binary, label double, order long, id string, text long"
    )
    got = coded.withColumn("_all", F.col("label") * 0).groupBy("_all").applyInArrow(one, "bias double, features binary, weights binary, rows long").first()
    if got is None:
        return Model(0.0, np.zeros(0, np.uint32), np.zeros(0))
    return Model(got["bias"], np.frombuffer(got["features"], np.uint32), np.frombuffer(got["weights"], np.float64), got["rows"])


def score(documents: DataFrame, model: Model, text: str = "text", into: str = "score", words_into: str | None = None) -> DataFrame:
    """Add ``into``: the probability that the whole text is toxic.  A null or empty text scores by the bias alone.

    With ``words_into``, the number of words is added too.  Input columns of these names are replaced.
    """
    added = [into, *([words_into] if words_into else [])]
    kept = [c for c in documents.columns if c not in added]
    place = kept.index(text)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out, n_words = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in text_slices(batch.column(place)):
                total = np.zeros(len(offsets) - 1)
                if len(m.features) or words_into:
                    w = words(data, offsets, SIGNS, lower=True)
                    n_words.append(np.diff(w.first))
                if len(m.features):
                    found, doc = features(w)
                    at = np.minimum(np.searchsorted(m.features, found), len(m.features) - 1)
                    hit = m.features[at] == found
                    found, doc = _distinct(found[hit], doc[hit])
                    total += np.bincount(doc, m.weights[np.searchsorted(m.features, found)], len(total))
                out.append(1.0 / (1.0 + np.exp(-np.clip(total + m.bias, -35, 35))))
            extra = [pa.array(np.concatenate(n_words), pa.int64())] if words_into else []
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(np.concatenate(out)), *extra], names=[*kept, *added])

    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField(into, T.DoubleType())])
    if words_into:
        schema = schema.add(words_into, T.LongType())
    return documents.select(*kept).mapInArrow(task, schema)


def held_out(key: str = "doc_id") -> Column:
    """A fifth of all documents, by checksum of the id; their labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``documents``."""
    model = train(documents, labels.where(~held_out()))
    return score(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
