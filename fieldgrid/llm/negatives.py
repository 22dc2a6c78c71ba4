"""Hard-negative mining with rotated one-bit codes and Cauchy-Schwarz residual intervals.

Every integer vector ``o`` is turned by one random rotation.  Its code ``b`` holds the signs of the turned components as
bits, read as a unit vector of ``+-1 / sqrt(dims)``; stored beside it are the alignment ``a = <o, b>`` and the length of
the residual ``e = o - a b``, which is at right angles to ``b``.  The residual is coded in the same way again, ``LEVELS``
times in all.  An anchor is turned likewise and each component written in ``PLANES`` bits, so that ``<b, q>`` is a weighted
sum of popcounts of ``code AND plane``.  The score is estimated by the sum of ``a <b, q>`` over the levels.  What is left,
``<e, q>``, is at most ``|e| * sqrt(|q|**2 - <b, q>**2)`` by Cauchy and Schwarz, ``e`` being at right angles to the last
``b``; with the rounding of the planes this gives an interval that holds the true score for certain.

Candidates whose interval lies outside what is asked for, or below what has been found so far, are dropped level by
level; those that stay are scored as integers.  So results are exact.

Candidates are packed in shards by scan partition, each sorted by label, and coded once.  Anchors are dealt by hash into
groups of about ``GROUP``; a group is broadcast and meets every shard where it lies, so vectors never travel.  A group is two
passes: positives (the best of the same label), and negatives (the best inside each positive's band).  A task sends at
most ``k`` rows for each anchor, or anchor and positive, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import EXACT, Stored, finite_vectors, pack_integers, quantised, unpack_integers

SHARD = 8192  # vectors in a shard
GROUP = 16_384  # anchors that are broadcast together, on average
LEVELS = 4  # codes of a vector
PLANES = 8  # bits of an anchor's component
SEED = 12
SLACK = 1e-9  # relative; far above the rounding of intervals in doubles

_NONE = np.iinfo(np.int64).min  # a score that is not there


@cache
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random rotation (or reflection), the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    words = -(-signs.shape[1] // 64)
    padded = np.zeros((len(signs), words * 64), bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(len(signs), words)


def codes(values: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``bits, alignment, residual, length``: the first three by level, then by vector."""
    n, dims = values.shape
    left = values.astype(np.float64) @ rotation(dims)
    bits, alignment, residual = [], [], []
    for _ in range(levels):
        signs = left > 0
        unit = np.where(signs, 1.0, -1.0) / np.sqrt(max(dims, 1))
        along = (left * unit).sum(1)
        left = left - along[:, None] * unit
        bits.append(_bits(signs))
        alignment.append(along)
        residual.append(np.sqrt((left * left).sum(1)))
    length = np.sqrt((values.astype(np.float64) ** 2).sum(1))
    return np.stack(bits), np.stack(alignment), np.stack(residual), length


class Anchors:
    """Turned anchors in bit planes."""

    def __init__(self, values: np.ndarray, planes: int = PLANES):
        n, dims = values.shape
        q = values.astype(np.float64) @ rotation(dims)
        self.values, self.dims = values, dims
        self.low = q.min(1, initial=0.0)
        self.step = (q.max(1, initial=0.0) - self.low) / (2**planes - 1)
        digits = np.rint((q - self.low[:, None]) / np.where(self.step > 0, self.step, 1.0)[:, None]).astype(np.uint64)
        self.planes = np.stack([_bits((digits >> np.uint64(p)) & np.uint64(1) > 0) for p in range(planes)], axis=1)
        near = self.low[:, None] + self.step[:, None] * digits
        self.sum, self.off = near.sum(1), np.sqrt(((q - near) ** 2).sum(1))
        self.length = np.sqrt((values.astype(np.float64) ** 2).sum(1))
        self.weights = 2.0 ** np.arange(planes)

    def along(self, a: int, bits: np.ndarray) -> np.ndarray:
        """``<b, q>`` for the rounded anchor ``a`` and the codes ``bits``, by popcounts."""
        ones = np.bitwise_count(bits).sum(1)
        counts = np.bitwise_count(bits[:, None, :] & self.planes[a][None]).sum(2) @ self.weights
        return (2.0 * (self.low[a] * ones + self.step[a] * counts) - self.sum[a]) / np.sqrt(max(self.dims, 1))


class Shard:
    """Coded candidates of one length, sorted by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, coded: tuple):
        self.ids, self.labels, self.values = ids, labels, values
        self.bits, self.alignment, self.residual, self.length = coded
        self.most = float(np.abs(values).max()) if values.size else 0.0
        self.doubles = values.astype(np.float64)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        if self.values.shape[1] * self.most * float(np.abs(query).max(initial=0)) < EXACT:
            return (self.doubles[at] @ query.astype(np.float64)).astype(np.int64)
        return (self.values[at].astype(np.int64) * query.astype(np.int64)).sum(1)

    def surviving(self, anchors: Anchors, a: int, at: np.ndarray, floor: float, roof: float, best: int = 0) -> np.ndarray:
        """Those of ``at`` whose interval meets ``[floor, roof]``, level by level.

        With ``best``, only so many of highest score are wanted, so that many lower ends raise the floor, too.
        """
        total = np.zeros(len(at))
        q = anchors.length[a]
        for level in range(len(self.bits)):
            if not len(at):
                break
            along = anchors.along(a, self.bits[level, at])
            total = total + self.alignment[level, at] * along
            rest = self.residual[level, at]
            across = np.sqrt(np.maximum(q * q - np.maximum(np.abs(along) - anchors.off[a], 0.0) ** 2, 0.0))
            wide = rest * across + (self.length[at] + rest) * anchors.off[a] + SLACK * (1.0 + self.length[at] * q)
            if best and len(at) > best:
                floor = max(floor, float(np.partition(total - wide, len(at) - best)[len(at) - best]))
            keep = (total + wide >= floor) & (total - wide <= roof)
            at, total = at[keep], total[keep]
        return at


def pack(rows: DataFrame, scale: float) -> DataFrame:
    """Shards of ``id, label, vector`` with their codes; other rows than usable ones are left out."""

    def shard(ids: list, labels: list, values: list) -> pa.RecordBatch:
        i, y, v = np.concatenate(ids), np.concatenate(labels), np.concatenate(values)
        order = np.argsort(y, kind="stable")
        i, y, v = i[order], y[order], v[order]
        width, data = pack_integers(v)
        bits, alignment, residual, length = codes(v)
        raw = [i.astype("<i8"), y.astype("<i8"), data, bits, alignment, residual, length]
        binary = [pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in raw]
        return pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([width], pa.int32()), *binary], names=names)

    names = ["dims", "width", "ids", "labels", "data", "bits", "alignment", "residual", "length"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        count: dict[int, int] = {}
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for at, x in finite_vectors(batch.column(2)):
                values, dims, begin = quantised(x, scale, 1.0), x.shape[1], 0
                while begin < len(at):
                    end = min(len(at), begin + SHARD - count.get(dims, 0))
                    for part, new in zip(held.setdefault(dims, ([], [], [])), (ids[at[begin:end]], labels[at[begin:end]], values[begin:end])):
                        part.append(new)
                    count[dims] = count.get(dims, 0) + end - begin
                    begin = end
                    if count[dims] == SHARD:
                        yield shard(*held.pop(dims))
                        del count[dims]
        for parts in held.values():
            yield shard(*parts)

    return rows.select("id", "label", "vector").mapInArrow(
        task, "dims int, width int, " + ", ".join(f"{c} binary" for c in names[2:])
    )


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[int, Shard]]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        dims = row["dims"]
        ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        n = len(ids)
        values = unpack_integers(row["width"], row["data"], dims) if dims else np.zeros((n, 0), np.int64)
        bits = np.frombuffer(row["bits"], "<u8").reshape(LEVELS, n, -1)
        alignment, residual = (np.frombuffer(row[c], "<f8").reshape(LEVELS, n) for c in ("alignment", "residual"))
        yield dims, Shard(ids, labels, values, (bits, alignment, residual, np.frombuffer(row["length"], "<f8")))


class Best:
    """The ``k`` best (score, id) of every place, higher scores and then smaller ids first."""

    def __init__(self, places: int, k: int):
        self.k, self.score, self.id = k, np.full((places, k), _NONE), np.zeros((places, k), np.int64)

    def worst(self, place: int) -> int:
        return int(self.score[place, -1])

    def add(self, place: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.score[place, -1]
        if not good.any():
            return
        s, i = np.append(self.score[place], scores[good]), np.append(self.id[place], ids[good])
        first = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises, and every integer has it
        self.score[place], self.id[place] = s[first], i[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, rank = np.nonzero(self.score != _NONE)
        return place, self.id[place, rank], self.score[place, rank]


def _positives(shards: DataFrame, group: Broadcast, k: int) -> DataFrame:
    """``place, id, score``: of every task the best of the anchor's own label and length, other ids only."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = None, None
        for batch in batches:
            for dims, shard in _shards(batch):
                if anchors is None:
                    anchors = {n: (place, ids, labels, Anchors(values)) for n, (place, ids, labels, values, _) in group.value["by_length"].items()}
                    best = Best(group.value["places"], k)
                if dims not in anchors:
                    continue
                place, ids, labels, turned = anchors[dims]
                begin, end = np.searchsorted(shard.labels, labels), np.searchsorted(shard.labels, labels, side="right")
                for a in range(len(ids)):
                    at = np.arange(begin[a], end[a])
                    at = at[shard.ids[at] != ids[a]]
                    at = shard.surviving(turned, a, at, float(best.worst(place[a])), np.inf, k)
                    if len(at):
                        best.add(place[a], shard.scores(at, turned.values[a]), shard.ids[at])
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["place", "id", "score"])

    return shards.mapInArrow(task, "place long, id long, score long")


def _negatives(shards: DataFrame, group: Broadcast, k: int, low: int, high: int) -> DataFrame:
    """``place, slot, id, score``: of every task the best of other labels within the band of each positive."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = None, None
        slots = group.value["slots"]
        for batch in batches:
            for dims, shard in _shards(batch):
                if anchors is None:
                    anchors = {n: (place, labels, Anchors(values), scores) for n, (place, _, labels, values, scores) in group.value["by_length"].items()}
                    best = Best(group.value["places"] * slots, k)
                if dims not in anchors:
                    continue
                place, labels, turned, positives = anchors[dims]
                begin, end = np.searchsorted(shard.labels, labels), np.searchsorted(shard.labels, labels, side="right")
                for a in range(len(labels)):
                    tops = positives[a]  # Python integers, highest first
                    bands = [(-(-low * p // high), p) for p in tops]  # low * p <= high * score <= high * p
                    open_ = [(s, lo, p) for s, (lo, p) in enumerate(bands) if lo <= p]
                    if not open_:
                        continue
                    floor = min(max(lo, best.worst(place[a] * slots + s)) for s, lo, _ in open_)
                    at = np.concatenate([np.arange(begin[a]), np.arange(end[a], len(shard.ids))])
                    at = shard.surviving(turned, a, at, float(floor), float(max(p for _, _, p in open_)))
                    if not len(at):
                        continue
                    scores = shard.scores(at, turned.values[a])
                    for s, lo, p in open_:
                        inside = (scores >= lo) & (scores <= p)
                        if inside.any():
                            best.add(place[a] * slots + s, scores[inside], shard.ids[at[inside]])
        if best is not None:
            at, ids, scores = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at // slots, at % slots, ids, scores)], names=["place", "slot", "id", "score"])

    return shards.mapInArrow(task, "place long, slot long, id long, score long")


def mine(
    rows: DataFrame, is_anchor: str, k_positives: int = 5, k_negatives: int = 5, band: tuple[int, int] = (80, 100), scale: float = 256.0
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``id, label, vector``.

    Scores are inner products of ``floor(scale * x)``.  An anchor's positives are its ``k_positives`` best of the same
    label; a positive's negatives its ``k_negatives`` best of other labels with
    ``band[0] * positive <= band[1] * negative <= band[1] * positive``, so a positive below zero has none.  Ties go to the
    smaller id.  Rows that lack an id, a label or a vector, or hold a null or non-finite component, take no part, and
    vectors of different lengths do not meet.  Rows that repeat an id are candidates each, but never of an anchor of
    that id; equal anchor rows count once, and anchors that share an id only are anchors each.  Other columns are not read.
    Components beyond the 63-bit range of scores raise.
    """
    spark = rows.sparkSession
    low, high = band
    known = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    table = Stored(spark, "negatives")
    shards = table.put(pack(known, scale), "shards")

    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    chosen = known.where(is_anchor).where(~bad).select("id", "label", whole.alias("vector")).distinct()
    groups = max(1, -(-chosen.count() // GROUP))
    number = F.pmod(F.xxhash64("id", "vector"), F.lit(groups)).cast("int")
    anchors = table.put(chosen.withColumn("part", number).repartition(groups, "part"), "anchors")
    found = "anchor_id long, positive_id long, slot int, rank int, negative_id long, positive_score long, negative_score long"
    results = spark.createDataFrame([], found)

    order = Window.partitionBy("place").orderBy(F.desc("score"), "id")
    inside = Window.partitionBy("place", "slot").orderBy(F.desc("score"), "id")
    for part in range(groups):
        mine_ = anchors.where(F.col("part") == part).select("id", "label", "vector").orderBy("id", "label", "vector").collect()  # one group
        if not mine_:
            continue
        at: dict[int, list[int]] = {}
        for place, r in enumerate(mine_):
            at.setdefault(len(r["vector"]), []).append(place)

        def sent(positives: dict[int, list[int]]) -> Broadcast:
            by_length = {
                n: (
                    np.array(places),
                    np.array([mine_[p]["id"] for p in places], np.int64),
                    np.array([mine_[p]["label"] for p in places], np.int64),
                    np.array([mine_[p]["vector"] for p in places], np.int64).reshape(len(places), n),
                    [positives.get(p, []) for p in places],
                )
                for n, places in at.items()
            }
            return spark.sparkContext.broadcast({"places": len(mine_), "slots": k_positives, "by_length": by_length})

        first = sent({})
        tops = _positives(shards, first, k_positives).withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < k_positives)
        tops = table.put(tops, f"positives-{part}")
        scores: dict[int, list[int]] = {}
        for r in tops.orderBy("place", "slot").select("place", "score").collect():  # a group's anchors times k_positives
            scores.setdefault(r["place"], []).append(r["score"])
        second = sent(scores)
        hard = _negatives(shards, second, k_negatives, low, high).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= k_negatives)
        ids = spark.createDataFrame([(p, r["id"]) for p, r in enumerate(mine_)], "place long, anchor_id long")
        pairs = (
            hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
            .join(tops.select("place", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["place", "slot"])
            .join(F.broadcast(ids), "place")
            .select("anchor_id", "positive_id", F.col("slot").cast("int").alias("slot"), "rank", "negative_id", "positive_score", "negative_score")
        )
        results = table.put(pairs, "mined", append=True)
        first.unpersist()
        second.unpersist()
        table.drop(f"positives-{part}")
    table.drop("shards")
    table.drop("anchors")
    return results.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "slot")


def report(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose ``vec_id`` is divisible by 100; where it is divisible by 7, the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, "id % 100 = 0").drop("slot")
