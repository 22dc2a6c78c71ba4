import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.llm import centroids, negatives
from fieldgrid.llm.vectors import quantised

SCHEMA = "vec_id long, embedding array<double>, label int, distance string, score double, id string"


def frame(spark, rows, parts=5):
    """Columns whose names clash with those of the results are there and never read."""
    return spark.createDataFrame([(*r, "x", 1.5, "y") for r in rows], SCHEMA).repartition(parts)


def odd_vectors(n=400, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.4, (6, dims))
    rows = [(i, (middle[i % 6] + rng.normal(0, 0.05, dims)).tolist(), i % 6) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * (dims - 1), 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] * dims, 2)]
    rows += [(n + 4, [], 1), (n + 5, [0.5] * (dims - 1), 1), (n + 6, [0.0] * dims, None)]
    rows += [rows[0], rows[0], rows[7], (100, rows[7][1], 3), (None, [0.1] * dims, 2), (None, None, None)]
    return rows


def lloyd(vectors, seeds, rounds):
    v, c = np.array(vectors, np.int64), np.array(seeds, np.int64)
    for step in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        if step < rounds:
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = v[at == j].sum(0) // (at == j).sum()
    return at, d.min(1), c


def kept(rows, dims, scale):
    good = [(i, x) for i, x, _ in rows if x is not None and len(x) == dims and None not in x and np.isfinite(x).all()]
    return [i for i, _ in good], np.floor(scale * np.array([x for _, x in good])).astype(np.int64)


def test_centroids_against_plain_rounds(spark):
    rows = odd_vectors()
    ids, v = kept(rows, 64, 64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), v[i].tolist()))
    at, distance, c = lloyd(v, v[order[:16]], 3)
    got = centroids.report(frame(spark, rows)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(zip(ids, at.tolist(), distance.tolist()), key=key)
    for r in got:
        assert r.inertia == distance.sum() and r.cluster_inertia == distance[at == r.cluster].sum()
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster].tolist())).encode()).hexdigest()


def test_centroids_scan_few_vectors_of_clear_clusters(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 3, (5, 16))
    rows = [(i, (middle[i % 5] + rng.normal(0, 0.2, 16)).tolist(), 0) for i in range(3000)]
    ids, v = kept(rows, 16, 64)
    seeds = v[:5]
    got = centroids.kmeans(frame(spark, rows), seeds, 6, 64.0)
    at, distance, c = lloyd(v, seeds, 6)
    assert {r.vec_id: (r.cluster, r.distance) for r in got.members.collect()} == dict(zip(ids, zip(at.tolist(), distance.tolist())))
    assert (got.centroids == c).all() and got.counts.sum() == 3000 and got.inertia.sum() == distance.sum()
    assert got.scanned[0] == 3000 and sum(got.scanned[1:]) == 0


def test_centroids_stay_without_vectors_and_go_below_zero(spark):
    rows = [(i, [-0.5 - 0.01 * i, 0.25], 0) for i in range(9)]
    seeds = np.array([[-40, 16], [9000, 9000], [-40, 16]])  # the second is never nearest, the third always ties
    got = centroids.kmeans(frame(spark, rows), seeds, 2, 64.0)
    at, _, c = lloyd(kept(rows, 2, 64)[1], seeds, 2)
    assert (got.centroids == c).all() and (c[1] == 9000).all() and got.counts[1] == 0
    assert {r.vec_id: r.cluster for r in got.members.collect()} == dict(enumerate(at.tolist()))


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 63, 1), (2, [float("nan")] * 64, 2)]])
def test_vector_queries_without_a_usable_row(spark, rows):
    assert centroids.report(frame(spark, rows)).collect() == []
    assert negatives.report(frame(spark, rows)).collect() == []


def test_one_vector_is_its_own_centroid(spark):
    (r,) = centroids.report(frame(spark, [(7, [0.5] * 64, 1)])).collect()
    assert (r.vec_id, r.cluster, r.distance, r.inertia) == (7, 0, 0, 0)


def test_planar_bound_holds_and_is_below_the_drift():
    rng = np.random.default_rng(0)
    tighter = 0
    for _ in range(300):
        dims = int(rng.integers(2, 6))
        centre, before, move = rng.normal(0, 5, dims), rng.normal(0, 5, dims), rng.normal(0, rng.choice([0.01, 0.5, 3.0]), dims)
        radius = abs(rng.normal(0, 2))
        way = rng.normal(size=(400, dims))
        x = centre + radius * way / np.linalg.norm(way, axis=1)[:, None] * rng.random((400, 1)) ** 0.1
        closer = np.linalg.norm(x - before, axis=1) - np.linalg.norm(x - before - move, axis=1)
        bound = centroids.loosening(centre, np.array([radius]), before, before + move)[0]
        assert closer.max() <= bound <= np.linalg.norm(move) * (1 + 1e-8) + 1e-8
        tighter += bound < 0.9 * np.linalg.norm(move)
    assert tighter > 100


def test_large_components_are_exact_or_raise(spark):
    v = np.array([[2**26, -(2**26)] * 4, [2**26 - 1, 5] * 4])
    want = ((v[:, None, :] - v[None]) ** 2).sum(2)
    assert (centroids.squared_distances(v, v) == want).all()
    with pytest.raises(ValueError):
        quantised(np.array([[1e12, 0.0]]), 64.0, 4.0)


def brute_negatives(rows, k=5):
    v = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(x, float)).astype(np.int64)) for i, x, y in rows if i is not None and y is not None and x is not None and None not in x and np.isfinite(x).all()]
    out = []
    for i, y, e in {(i, y, tuple(e.tolist())) for i, y, e in v if i % 100 == 0}:
        others = sorted((-int(np.dot(e, f)), j, z) for j, z, f in v if j != i and len(f) == len(e))
        for s, j, z in [o for o in others if o[2] == y][:k]:
            inside = [o for o in others if o[2] != y and 80 * -s <= 100 * -o[0] <= 100 * -s]
            out += [(i, j, n + 1, m, -s, -t) for n, (t, m, _) in enumerate(inside[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,dims", [(3, 64), (4, 64), (5, 7), (6, 130)])
def test_negatives_against_brute_force(spark, seed, dims):
    rows = odd_vectors(700, dims, seed)
    rows += [(1000 + i, rows[12][1], i % 3) for i in range(40)]  # ties
    got = negatives.report(frame(spark, rows, 7))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_negatives_in_several_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 3)
    rows = odd_vectors(1500, 16, 9)
    assert sorted(tuple(r) for r in negatives.report(frame(spark, rows, 3)).collect()) == brute_negatives(rows)


def test_intervals_hold_and_drop_most_candidates():
    rng = np.random.default_rng(2)
    v = rng.normal(0, 30, (2000, 64)).astype(np.int64)
    v[:20] = v[0] + rng.integers(-9, 9, (20, 64))
    shard = negatives.Shard(np.arange(2000), np.zeros(2000, np.int64), v, negatives.codes(v))
    anchors = negatives.Anchors(v[:30])
    left = 0
    for a in range(30):
        scores = v @ v[a]
        floor = np.sort(scores)[-8]
        stay = shard.surviving(anchors, a, np.arange(2000), float(floor), np.inf, 8)
        assert set(np.flatnonzero(scores >= floor)) <= set(stay.tolist())
        roof = float(np.sort(scores)[20])
        assert set(np.flatnonzero(scores <= roof)) <= set(shard.surviving(anchors, a, np.arange(2000), -np.inf, roof).tolist())
        assert (shard.scores(stay, v[a]) == scores[stay]).all()
        left += len(stay)
    assert left < 0.2 * 30 * 2000


def test_rotation_keeps_products():
    for dims in (1, 3, 64):
        r = negatives.rotation(dims)
        assert np.allclose(r @ r.T, np.eye(dims))


def test_usable_vectors(spark):
    got = frame(spark, odd_vectors()).select("vec_id", centroids.usable(64).alias("ok")).where(~F.col("ok")).collect()
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == [400, 401, 402, 403, 404, 405]
