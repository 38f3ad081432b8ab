"""Bit-sliced search against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import bit_slices


def brute(rows, k, scale=1024):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in good if i % 10 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def search(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = bit_slices.top_inner_products(df, F.col("vec_id") % 10 == 0, k)
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}


def test_random_rows(spark):
    chance = random.Random(1)
    rows = [(i, [chance.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    assert search(spark, rows) == brute(rows, 5)


def test_ties_nulls_and_odd_vectors(spark):
    same = [0.25, -0.5, 1.0]
    rows = [(i, same) for i in range(150)] + [(i, [0.0, 0.0, 0.0]) for i in range(150, 160)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (210, [math.nan, 1.0, 1.0]), (211, [math.inf, 0.0, 0.0]), (None, same), (220, []), (221, [3.0]), (230, [1e6, -1e6, 1e5])]
    rows += [(300, same), (300, same)]
    assert search(spark, rows) == brute(rows, 5)


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert search(spark, rows) == brute(rows, 5) == {(0, 1, 1, 1024 * 2048)}
    assert search(spark, [(0, [1.0])]) == set() == search(spark, [])


def test_small_question_batches_give_the_same(spark, monkeypatch):
    chance = random.Random(2)
    rows = [(i, [chance.random() for _ in range(8)]) for i in range(120)]
    monkeypatch.setattr(bit_slices, "QUESTION_BYTES", 200)
    assert search(spark, rows) == brute(rows, 5)


def test_growing_shares_give_the_same(spark, monkeypatch):
    chance = random.Random(3)
    monkeypatch.setattr(bit_slices, "growing_shares", lambda rows: [(0.0, 0.1), (0.1, 0.5), (0.5, 1.0)])
    rows = [(i, [chance.gauss(0, 1) for _ in range(6)] if i % 3 else [0.5] * 6) for i in range(500)] + [(20, [0.1] * 6), (20, [0.9] * 6)]
    got, want = search(spark, rows), brute([r for r in rows if r[0] != 20], 5)
    assert {r for r in got if r[0] != 20} == {r for r in brute(rows, 5) if r[0] != 20} and want


@pytest.mark.parametrize("tasks", [4, 32])
def test_rows_that_go_on_follow_the_questions_and_not_the_tasks(spark, tasks):
    values = np.floor(np.random.default_rng(4).normal(size=(40_000, 6)) * 64).astype(int)
    values[::3] = 20
    df = spark.createDataFrame(pa.table({"id": np.arange(len(values)), "v": values.tolist()})).repartition(tasks)
    asked = np.arange(20) * 100, [values[i * 100].astype(np.int64) for i in range(20)]
    assert bit_slices._candidates(df, len(values), asked, 10).count() <= 3 * 20 * 10


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_a_block(data):
    n, d = data.draw(st.integers(1, 200)), data.draw(st.integers(1, 6))
    chance = np.random.default_rng(data.draw(st.integers(0, 999)))
    values = chance.integers(-(10 ** data.draw(st.integers(0, 6))), 10 ** data.draw(st.integers(0, 6)) + 1, (n, d))
    question = chance.integers(-500, 500, d)
    block = bit_slices.BitSlicedBlock(np.arange(n), values)
    coarse = (values - block.low) >> block.shift
    up = np.where(question < 0, (1 << block.bits) - 1 - coarse, coarse)
    sums = up @ np.abs(question)
    slices = block.score_slices(question)
    read = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(np.int64) << i for i, s in enumerate(slices)), np.zeros(n, np.int64))
    assert (read == sums).all()
    ids, scores = block.top(question, -1, 7)
    order = np.lexsort((np.arange(n), -(values @ question)))[:7]
    assert list(ids) == list(order) and list(scores) == list((values @ question)[order])
