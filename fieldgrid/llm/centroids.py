"""Centroid clustering on integer vectors with geometric drift tightening.

Every vector keeps its cluster, an upper bound on the distance to its own centroid and a lower bound on the distance to
all others.  When centroids move, the upper bound grows by the drift of its own centroid.  The lower bound would have to
give way by the largest drift of another centroid; usually much less is enough.  All vectors of a cluster whose upper
bound is at most ``r`` lie in a sphere of radius ``r`` around its old centroid ``c``.  Let another centroid move from
``a`` to ``b`` with middle ``m``.  A vector ``x`` gets closer to it by

    |x - a| - |x - b| = 2 (x - m)(b - a) / (|x - a| + |x - b|) <= |b - a| cos(angle between x - m and b - a),

because both distances together are at least ``2 |x - m|``.  Turning ``x`` about the line through ``a`` and ``b`` into the
half-plane of ``c`` keeps the angle and brings ``x`` no further from ``c``, so the plane through ``a``, ``b`` and ``c``
decides: there the sphere is a disc, seen from ``m`` under the half angle ``asin(r / |c - m|)``, and the least angle is
that of ``c`` less this half angle.  Where it is 90 degrees or more, nothing gets closer at all.

Bounds are given way by shells of the sphere, so a vector near its centroid keeps more than one at the rim.  A vector
whose upper bound stays below its lower bound keeps its cluster; the others are scanned exactly, in integers.

Vectors travel in packed blocks.  A round is one pass over the blocks of the round before: tasks write the new blocks
together with what has changed in their sums, and Spark adds those up by position, so the driver sees ``k`` centroids
only and no vector is ever shuffled.  Rounds are Parquet tables in the shared folder, so a lost executor repeats tasks
of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import EXACT, Stored, finite_vectors, pack_integers, quantised, unpack_integers

BLOCK = 4096  # vectors in a block
SHELLS = 16  # steps of the radius for which the loosening is worked out
SLACK = 1e-9  # relative; far above the rounding of bounds kept in doubles

_BLOCKS = "ids array<bigint>, width int, data binary, cluster binary, upper binary, lower binary, changes array<bigint>"


@dataclass
class Clusters:
    """Centroids after the last round, what is in the clusters, and where each vector is."""

    centroids: np.ndarray
    counts: np.ndarray
    inertia: np.ndarray  # squared distances summed over each cluster
    members: DataFrame  # id, cluster, distance
    scanned: list[int] = field(default_factory=list)  # vectors scanned against all centroids, by round


def pack(vectors: DataFrame, dims: int, scale: float, key: str, vector: str) -> DataFrame:
    """``ids, width, data``: blocks of at most ``BLOCK`` quantised vectors of ``dims`` components, by scan partition."""

    def block(ids: list, rows: list) -> pa.RecordBatch:
        width, data = pack_integers(np.concatenate(rows))
        columns = [pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "width", "data"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            for at, x in finite_vectors(batch.column(1)):
                if x.shape[1] != dims:
                    continue
                keys, q = batch.column(0).take(pa.array(at)).to_pylist(), quantised(x, scale, 4.0)
                begin = 0
                while begin < len(q):
                    end = min(len(q), begin + BLOCK - held)
                    ids.append(keys[begin:end])
                    rows.append(q[begin:end])
                    held += end - begin
                    begin = end
                    if held == BLOCK:
                        yield block(ids, rows)
                        ids, rows, held = [], [], 0
        if held:
            yield block(ids, rows)

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(task, "ids array<bigint>, width int, data binary")


def squared_distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    if not len(values):
        return np.zeros((0, len(centroids)), np.int64)
    most = float(max(np.abs(values).max(), np.abs(centroids).max())) if values.size else 0.0
    if 4.0 * values.shape[1] * most**2 < EXACT:
        v, c = values.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    if 4.0 * values.shape[1] * most**2 >= 2.0**63:
        raise ValueError("components too large for 64-bit squared distances")
    return np.stack([((values.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)


def loosening(centre: np.ndarray, radius: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much closer a moved centroid can get to vectors within each radius of ``centre``, at most."""
    move, middle = after - before, (before + after) / 2.0
    drift, gap = float(np.linalg.norm(move)), float(np.linalg.norm(centre - middle))
    if drift == 0.0:
        return np.zeros(len(radius))
    if gap == 0.0:
        return np.full(len(radius), drift)
    angle = np.arccos(np.clip((centre - middle) @ move / (gap * drift), -1.0, 1.0))
    least = angle - np.arcsin(np.minimum(1.0, radius / gap)) - 1e-7  # both are that exact near their ends
    closer = drift * np.cos(np.clip(least, 0.0, np.pi / 2))
    return np.where(radius >= gap, drift, np.minimum(drift, closer)) * (1 + SLACK) + SLACK


def _give_way(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drift of every centroid, and by cluster and shell how much its lower bounds have to give way."""
    k = len(before)
    table = np.zeros((k, SHELLS))
    for i in range(k):
        shells = radii[i] * np.arange(1, SHELLS + 1) / SHELLS * (1 + SLACK)
        for j in range(k):
            if j != i:
                table[i] = np.maximum(table[i], loosening(before[i], shells, before[j], after[j]))
    drift = np.linalg.norm(after - before, axis=1)
    return drift * (1 + SLACK), table


def _round(blocks: DataFrame, sent: Broadcast, exact: bool) -> DataFrame:
    """One assignment of all blocks.  ``sent``: the centroids, and drift, table and radii since the last assignment, if
    there was one; ``exact``: own distances, too.

    ``changes`` holds, for adding up by position: counts and sums of vectors that came less those that went, radii, sums
    of squared own distances, and the number of vectors scanned.
    """
    k, dims = sent.value[0].shape

    def one(values: np.ndarray, old: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        c, since = sent.value
        cluster = old.copy()
        if since is None:
            unsure = np.arange(len(values))
        else:
            drift, table, radii = since
            shell = np.ceil(SHELLS * upper / np.maximum(radii[old], 1e-300)).astype(np.int64)
            lower = lower - table[old, np.clip(shell, 1, SHELLS) - 1]
            upper = upper + drift[old]
            unsure = np.flatnonzero(upper * (1 + SLACK) + SLACK >= lower)
            if len(unsure):  # the true own distance may settle it
                own = ((values[unsure].astype(np.int64) - c[old[unsure]]) ** 2).sum(1)
                upper[unsure] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
                unsure = unsure[upper[unsure] * (1 + SLACK) + SLACK >= lower[unsure]]
        if len(unsure):
            d = squared_distances(values[unsure], c)
            cluster[unsure] = best = d.argmin(1)  # the first of equals
            own = d[np.arange(len(unsure)), best].copy()
            d[np.arange(len(unsure)), best] = np.iinfo(np.int64).max
            upper[unsure] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
            lower[unsure] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if k > 1 else np.inf
        came = np.ones(len(values), bool) if since is None else cluster != old
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        inertia, distance = np.zeros(k, np.int64), None
        radius = np.zeros(k)
        np.maximum.at(radius, cluster, upper)
        for i in range(k):
            sums[i] += values[came & (cluster == i)].sum(0, dtype=np.int64)
            if since is not None:
                sums[i] -= values[came & (old == i)].sum(0, dtype=np.int64)
        counts += np.bincount(cluster[came], minlength=k)
        if since is not None:
            counts -= np.bincount(old[came], minlength=k)
        if exact:
            distance = ((values.astype(np.int64) - c[cluster]) ** 2).sum(1)
            np.add.at(inertia, cluster, distance)
        changes = np.concatenate([counts, sums.ravel(), np.ceil(radius).astype(np.int64), inertia, [len(unsure)]])
        return cluster, upper, lower, changes, distance

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                values = unpack_integers(row["width"].as_py(), row["data"].as_py(), dims)
                if "cluster" in row:
                    old = np.frombuffer(row["cluster"].as_py(), "<i4").astype(np.int64)
                    upper, lower = (np.frombuffer(row[c].as_py(), "<f8").copy() for c in ("upper", "lower"))
                else:
                    old, upper, lower = np.zeros(len(values), np.int64), np.zeros(len(values)), np.zeros(len(values))
                cluster, upper, lower, changes, distance = one(values, old, upper, lower)
                if exact:  # distances replace the vectors, which are no longer needed
                    width, data = 8, distance.astype("<i8").tobytes()
                else:
                    width, data = row["width"].as_py(), row["data"].as_py()
                state = [cluster.astype("<i4").tobytes(), *((b"", b"") if exact else (upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(at, 1), pa.array([width], pa.int32()), *[pa.array([x], pa.binary()) for x in (data, *state)], pa.array([changes], pa.list_(pa.int64()))],
                    names=["ids", "width", "data", "cluster", "upper", "lower", "changes"],
                )

    return blocks.mapInArrow(task, _BLOCKS)


def _added_up(blocks: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Counts, sums, radii, inertia and scans of all blocks: one number a position reaches the driver."""
    rows = blocks.select(F.posexplode("changes").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("total"), F.max("n").alias("most")).collect()
    total, most = np.zeros(k * (dims + 3) + 1, np.int64), np.zeros(k * (dims + 3) + 1, np.int64)
    for r in rows:
        total[r["place"]], most[r["place"]] = r["total"], r["most"]
    a, b, c = k, k * (dims + 1), k * (dims + 2)
    return total[:a], total[a:b].reshape(k, dims), most[b:c].astype(np.float64), total[c : c + k], int(total[-1])


def kmeans(
    vectors: DataFrame, seeds: np.ndarray, rounds: int, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding"
) -> Clusters:
    """Exact rounds of assignment and update from given integer centroids, then one last assignment.

    Nearest is by squared Euclidean distance, ties to the smaller number; a centroid becomes the componentwise floor of
    its vectors' mean, and one without vectors stays.  Vectors that are null, hold a null or non-finite component or
    have another length than the centroids take no part; rows that repeat an id or lack one are vectors like any other.
    Components are ``floor(scale * x)`` and raise where sums of their squares would not fit 63 bits.
    """
    centroids = np.asarray(seeds, np.int64).copy()
    k, dims = centroids.shape
    table = Stored(vectors.sparkSession, "clusters")
    blocks, last = table.put(pack(vectors, dims, scale, key, vector), "blocks"), "blocks"
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    moved, scanned = None, []
    for number in range(rounds + 1):
        exact = number == rounds
        sent = vectors.sparkSession.sparkContext.broadcast((centroids, moved))
        blocks = table.put(_round(blocks, sent, exact), f"round-{number}")
        sent.unpersist()
        table.drop(last)
        last = f"round-{number}"
        more, more_sums, radii, inertia, scans = _added_up(blocks, k, dims)
        counts, sums = counts + more, sums + more_sums
        scanned.append(scans)
        if not exact:
            after = centroids.copy()
            full = counts > 0
            after[full] = sums[full] // counts[full][:, None]  # floors, also below zero
            moved = (*_give_way(centroids.astype(np.float64), after.astype(np.float64), radii), radii)
            centroids = after

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, cluster, distance = batch.column(0)[at].values, batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.frombuffer(cluster, "<i4")), pa.array(np.frombuffer(distance, "<i8"))], names=[key, "cluster", "distance"]
                )

    members = blocks.select("ids", "cluster", "data").mapInArrow(unpack, f"`{key}` long, cluster int, distance long")
    return Clusters(centroids, counts, inertia, members, scanned)


def usable(dims: int, vector: str = "embedding") -> Column:
    """Whether a vector has exactly ``dims`` components, none null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def first_by_hash(vectors: DataFrame, k: int, dims: int, scale: float, seed: int, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The ``k`` usable vectors of least SHA-256 of ``seed:id``, in that order, quantised; fewer if there are fewer.

    Rows without an id come last; rows of equal hash are ordered by their components.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = (
        vectors.where(usable(dims, vector))
        .select(order.alias("_order"), whole.alias("_vector"))
        .orderBy(F.col("_order").asc_nulls_last(), "_vector")
        .limit(k)
        .collect()
    )
    return np.array([r["_vector"] for r in rows], np.int64).reshape(len(rows), dims)


def report(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    No vector, no row.  Other columns of the input are not read, whatever their names.
    """
    narrow = embeddings.select("vec_id", "embedding")
    seeds = first_by_hash(narrow, k, dims, scale, seed)
    if not len(seeds):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return embeddings.sparkSession.createDataFrame([], empty)
    found = kmeans(narrow, seeds, rounds, scale)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    at = F.col("cluster") + 1
    return found.members.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.lit([int(x) for x in found.inertia]).cast("array<bigint>"), at).alias("cluster_inertia"),
        F.lit(int(found.inertia.sum())).cast("long").alias("inertia"),
        F.element_at(F.lit(digests), at).alias("centroid_sha256"),
    )
