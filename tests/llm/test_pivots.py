"""Clusters against k-means with every distance computed in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from lectern.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, scale, width, seed):
    kept = []
    for ident, vector, *_ in rows:
        if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((ident, [math.floor(scale * float(np.float32(x))) for x in vector]))
    start = sorted(
        (hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z", v) for i, v in kept
    )
    centroids = [v for _, v in start[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds if centroids else 0):
        where = [n for _, n in assigned()]
        for n in range(len(centroids)):
            own = [v for (_, v), w in zip(kept, where) if w == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned() if centroids else []
    total = sum(d for d, _ in found)
    return sorted(
        (repr(i), n, d, sum(e for e, m in found if m == n), total,
         hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
        for (i, _), (d, n) in zip(kept, found)
    )


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
    return sorted(
        (repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
        for r in pivots.clusters(df, **more).collect()
    )


def gaussians(n, width, seed=1):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(7, width))
    return [(i, (centres[i % 7] + 0.3 * random.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("k", [1, 2, 12])
def test_equals_brute_force(spark, k):
    rows = gaussians(300, 8)
    more = dict(k=k, rounds=3, scale=256, width=8, seed="2")
    assert got(spark, rows, **more) == brute(rows, **more)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)] + [(5, [2.0, 0.0]), (5, [9.0, 9.0]), (None, [1.0, 1.0])]
    rows += [(100, None), (101, [1.0]), (102, [1.0, 2.0, 3.0]), (103, [None, 1.0]), (104, [float("nan"), 0.0]), (105, [float("inf"), 0.0])]
    more = dict(k=9, rounds=4, scale=4, width=2, seed="s")
    assert got(spark, rows, **more) == brute(rows, **more)


def test_a_third_of_the_vectors_are_one(spark):
    rows = [(i, [0.5, -0.5, 0.25] if i % 3 == 0 else v) for i, v in gaussians(400, 3)]
    more = dict(k=10, rounds=3, scale=64, width=3, seed="2")
    assert got(spark, rows, **more) == brute(rows, **more)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = gaussians(5, 4)
    more = dict(k=40, rounds=2, scale=256, width=4, seed="2")
    assert got(spark, rows, **more) == brute(rows, **more)
    assert got(spark, [], **more) == []


def test_values_too_large_for_exact_products(spark):
    rows = [(i, [float(1 << 22) * (i % 5), float(i)]) for i in range(40)]
    more = dict(k=6, rounds=2, scale=64, width=2, seed="2")
    assert got(spark, rows, **more) == brute(rows, **more)


def test_bounds_hold_and_spare_most_distances():
    random = np.random.default_rng(3)
    centres = random.integers(-300, 300, size=(40, 16))
    vectors = centres[random.integers(0, 40, 4000)] + random.integers(-20, 20, size=(4000, 16))
    pairs = pivots.PivotPairs(centres)
    far = pairs.distances(vectors)
    exact = pivots.all_squares(vectors, centres)
    assert (pairs.least_squares(far, pairs.distances(centres)) <= exact).all()
    number, distance, compared = pivots.nearest_centroids(vectors, far, centres, pairs)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared <= 0.5 * exact.size
