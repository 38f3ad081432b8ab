"""Hard negatives against brute force, the packed order, and how much is packed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, every, positives, negatives, low, high, scale):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    asked = {(i, tuple(v), label) for i, v, label in kept if i % every == 0}
    out = []
    for i, v, label in asked:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in kept)
        own = [(j, -s) for s, j, m in scored if m == label and j != i][:positives]
        for j, p in own:
            window = [(n, -s) for s, n, m in scored if m != label and low * p <= -100 * s <= high * p]
            out += [(i, j, r, n, p, s) for r, (n, s) in enumerate(window[:negatives], 1)]
    return sorted(out)


def got(spark, rows, every=10, positives=5, negatives=10, low=30, high=90, scale=16):
    df = spark.createDataFrame([(i, v, label, 0) for i, v, label in rows], SCHEMA).repartition(5)
    found = H.hard_negatives(df, F.col("vec_id") % every == 0, positives, negatives, low, high, scale)
    return sorted(map(tuple, found.collect())), brute(rows, every, positives, negatives, low, high, scale)


def vectors(n, width=6, seed=1, labels=4):
    random = np.random.default_rng(seed)
    return [(i, (random.normal(size=width) + 0.5).tolist(), int(random.integers(labels))) for i in range(n)]


def test_equals_brute_force(spark):
    found, expected = got(spark, vectors(400))
    assert found == expected and len(found) > 1000


def test_in_growing_shares_and_batches_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(H, "growing_shares", lambda rows: [(0.0, 0.1), (0.1, 0.5), (0.5, 1.0)])
    monkeypatch.setattr(H, "ANCHOR_BYTES", 600)
    monkeypatch.setattr(H, "BLOCK_CELLS", 1000)
    found, expected = got(spark, vectors(400, seed=2))
    assert found == expected


def test_ties_repeats_zero_and_negative_scores(spark):
    rows = [(i, [float(i % 3 - 1), float(i % 2)], i % 2) for i in range(60)]
    rows += [(10, [1.0, 1.0], 0), (10, [1.0, 1.0], 0), (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (20, [0.0, 0.0], 1)]
    found, expected = got(spark, rows, scale=4, low=30, high=100)
    assert found == expected and {p for *_, p, _ in found} >= {0}


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 == 0 else v, label) for i, v, label in vectors(300, width=3)]
    found, expected = got(spark, rows)
    assert found == expected


def test_rows_that_take_no_part(spark):
    rows = vectors(50, width=2) + [
        (None, [1.0, 1.0], 1), (60, None, 1), (61, [1.0, None], 1), (62, [float("nan"), 1.0], 1), (63, [1.0, float("inf")], 1), (64, [1.0, 1.0], None), (70, [2.0], 1), (80, [], 2),
    ]
    found, expected = got(spark, rows)
    assert found == expected


def test_empty_table_no_anchor_and_a_lone_label(spark):
    assert got(spark, [])[0] == []
    assert got(spark, [(3, [1.0], 0)])[0] == []
    assert got(spark, [(10, [1.0], 0), (20, [1.0], 0)])[0] == []


def test_keys_sort_by_anchor_score_own_label_id():
    rows = [(n, a, s, own, i, p) for n in (0, 3) for a in (-5, 2) for s in (-(1 << 40), -1, 0, 7) for own in (True, False) for i in (-2, 9) for p in (0, 1 << 40)]
    random.Random(1).shuffle(rows)
    assert sorted(rows, key=lambda r: H.pack(*r)) == sorted(rows, key=lambda r: (r[0], r[1], -r[2], not r[3], r[4], r[5]))


@pytest.mark.parametrize("tasks", [4, 32])
def test_packed_pairs_follow_the_windows_and_not_the_tasks(spark, tasks):
    n, random = 20_000, np.random.default_rng(4)
    matrix = random.normal(size=(n, 8)) + 0.4
    df = spark.createDataFrame(
        [(i, v, i % 5) for i, v in enumerate(np.floor(matrix * 64).astype(int).tolist())], "id long, v array<long>, label long"
    ).repartition(tasks)
    every = np.arange(20)
    anchors = H.Anchors(every * 100, every * 100 % 5, np.floor(matrix[::1000][:20] * 64).astype(np.int64))
    windows = H.Windows(every, np.full(20, 50), np.full(20, 5000), False, 10)
    found = H._first_of_windows(df, n, anchors, windows).groupBy("window").count().collect()
    assert sum(r["count"] for r in found) <= 3 * 20 * 10
