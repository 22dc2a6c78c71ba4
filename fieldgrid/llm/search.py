"""Exact top-k inner-product search by MaxScore.

Vectors are quantised to integers.  A dimension is two terms, one for positive and one for negative components, so a
query has for each dimension one term that adds to the score and one that takes from it.  A shard holds, by term, the
postings (vector, magnitude) and the largest magnitude.  For a query the adding terms are ordered by bound, which is
query weight times largest magnitude.  With a threshold from the k-th best score so far, the terms of least bound whose
sum cannot reach it are non-essential: a vector found in none of the essential postings cannot enter the result.
Essential postings are traversed term at a time; the others are probed for the vectors that remain, and a vector is
dropped as soon as its score plus the bounds not yet probed falls below the threshold.  Results of shards are merged.

Shards and query blocks are packed inside scan partitions and have bounded size; every query block meets every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD, QUERIES = 8192, 1024  # vectors in a shard, queries in a block
BROADCAST_BYTES = 32 << 20  # packed queries up to this size are broadcast; beyond, blocks meet by a join


def _usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector is there and holds finite numbers only, and those vectors quantised."""
    rows, out = [], []
    for i, v in enumerate(column):
        if v.is_valid and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                rows.append(i)
                out.append(np.floor(256.0 * x))
    return np.array(rows, np.int64), out


def packed(vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``dims, rows, ids, data``: blocks of at most ``size`` quantised vectors of one length, by scan partition."""

    def block(dims: int, ids: list, rows: list) -> pa.RecordBatch:
        raw = np.array(rows, np.float64).reshape(len(rows), dims)
        return pa.RecordBatch.from_arrays(
            [pa.array([dims], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([raw.astype("<i8").tobytes()])],
            names=["dims", "rows", "ids", "data"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, x in zip(*_usable(batch.column(1))):
                ids, rows = held.setdefault(len(x), ([], []))
                ids.append(keys[i])
                rows.append(x)
                if len(rows) == size:
                    yield block(len(x), *held.pop(len(x)))
        for dims, (ids, rows) in held.items():
            yield block(dims, ids, rows)

    return vectors.select(F.col(key).cast("long"), vector).where(F.col(key).isNotNull()).mapInArrow(task, "dims int, rows int, ids binary, data binary")


class Shard:
    """Postings of one block of vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.postings, self.most = {}, np.zeros((2, values.shape[1]), np.int64)
        for d in range(values.shape[1]):
            for negative in (0, 1):
                at = np.flatnonzero(values[:, d] < 0 if negative else values[:, d] > 0)
                size = np.abs(values[at, d])
                self.postings[negative, d] = (at, size)
                self.most[negative, d] = size.max() if len(size) else 0

    def top(self, query: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best vectors but the query's own; ties go to the smaller id."""
        adding = np.where(weights < 0, 1, 0)
        bound = np.abs(weights) * self.most[adding, np.arange(len(weights))]
        order = np.argsort(bound, kind="stable")[::-1]  # largest first
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # bounds from each place on
        others = self.ids != query
        # A first threshold: exact scores of the vectors largest in the query's strongest term.
        lead = self.postings[adding[order[0]], order[0]] if len(order) else (np.zeros(0, np.int64),) * 2
        probe = lead[0][np.argsort(lead[1])[::-1][: 16 * k]]
        probe = np.union1d(probe, np.arange(min(len(self.ids), 4 * k)))
        probe = probe[others[probe]]
        best = np.sort(self.values[probe] @ weights)[::-1]
        threshold = best[k - 1] if len(best) >= k else None
        # Essential terms: those before the place from which all bounds together stay below the threshold.
        essential = len(order) if threshold is None else int(np.argmax(left < threshold)) if threshold > 0 else len(order)
        score = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for d in order[:essential]:
            at, size = self.postings[adding[d], d]
            score[at] += abs(weights[d]) * size
            seen[at] = True
        if threshold is None or threshold <= 0:
            seen[:] = True  # a vector without any adding posting scores 0 or less and may still be among the best
        live = np.flatnonzero(seen & others)
        now = score[live]
        for place in range(essential, len(order)):  # probe the rest, strongest first
            if threshold is not None:
                keep = now + left[place] >= threshold
                live, now = live[keep], now[keep]
            d = order[place]
            v = self.values[live, d] * weights[d]
            now = now + np.maximum(v, 0)
        for d in np.argsort(-np.abs(weights) * self.most[1 - adding, np.arange(len(weights))], kind="stable"):
            if threshold is not None:  # terms that take away only lower a score
                keep = now >= threshold
                live, now = live[keep], now[keep]
            if not len(live):
                break
            v = self.values[live, d] * weights[d]
            now = now + np.minimum(v, 0)
        if threshold is not None:
            keep = now >= threshold
            live, now = live[keep], now[keep]
        first = np.lexsort((self.ids[live], -now))[:k]
        return self.ids[live][first], now[first]


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for all rows that satisfy ``is_query``, against all rows but their own id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors of
    another length than the query's are no candidates.  Rows that repeat an id are candidates each; a repeated query
    id is answered once for each of its different vectors' best scores, ranked together.
    """
    wanted = vectors.where(is_query)
    count = wanted.count()
    parts = max(1, math.ceil(count / QUERIES))
    queries = cut(packed(wanted.repartition(parts, F.xxhash64(key)), key, vector, QUERIES))
    size = queries.agg(F.sum(F.octet_length("ids") + F.octet_length("data"))).first()[0] or 0
    shards = packed(vectors, key, vector, SHARD)
    right = queries.select("dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    if size <= BROADCAST_BYTES:
        pairs = shards.join(F.broadcast(right), "dims")
    else:  # blocks of queries are dealt a number; every shard goes to all numbers
        numbers = right.withColumn("_block", F.pmod(F.xxhash64("q_ids"), F.lit(parts)))
        every = F.explode(F.expr(f"sequence(0L, {parts - 1}L)"))
        pairs = shards.withColumn("_block", every).join(numbers, ["dims", "_block"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            for dims, ids, data, q_ids, q_data in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (ids, data) != last:
                    shard, last = Shard(np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(-1, dims)), (ids, data)
                out = []
                for q, w in zip(np.frombuffer(q_ids, "<i8").tolist(), np.frombuffer(q_data, "<i8").reshape(-1, dims)):
                    found, score = shard.top(q, w, k)
                    out.append((np.full(len(found), q), found, score))
                q, found, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = pairs.select("dims", "ids", "data", "q_ids", "q_data").mapInArrow(task, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The five best of every row whose id is divisible by 50."""
    return top_k(embeddings, F.col("vec_id") % 50 == 0)
