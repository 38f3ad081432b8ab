"""The search equals brute force, however many batches the questions make."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lectern.operators import neighbours as N
from lectern.operators.neighbours import _partial_hits, nearest
from lectern.operators.shares import SEED_ROWS, growing_shares

SCHEMA = T.StructType(
    [T.StructField("chunk_id", T.StringType()),
     T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
QUESTIONS = T.StructType(
    [T.StructField("question_id", T.LongType()),
     T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def vectors(spark, matrix):
    rows = [(f"c{i:05d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def asked(spark, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, QUESTIONS).repartition(2)


def brute(corpus, questions, k):
    out = set()
    for q, vector in enumerate(questions.astype(np.float32).astype(np.float64)):
        d = ((corpus.astype(np.float32).astype(np.float64) - vector) ** 2).sum(axis=1)
        best = sorted((round(x, 9), f"c{i:05d}") for i, x in enumerate(d))[:k]
        out |= {(q, rank, name) for rank, (_, name) in enumerate(best, 1)}
    return out


WAYS = {"one batch": {}, "many batches": {"batch_bytes": 500}}


def found(spark, corpus, questions, k, way):
    hits = nearest(vectors(spark, corpus), asked(spark, questions), k, **WAYS[way])
    return {(r.question_id, r["rank"], r.chunk_id) for r in hits.collect()}


@pytest.mark.parametrize("way", WAYS)
def test_equals_brute_force(spark, way):
    random = np.random.default_rng(1)
    corpus, questions = random.normal(size=(700, 8)), random.normal(size=(90, 8))
    assert found(spark, corpus, questions, 5, way) == brute(corpus, questions, 5)


@pytest.mark.parametrize("way", WAYS)
def test_a_third_of_the_corpus_is_one_vector(spark, way):
    random = np.random.default_rng(2)
    corpus = random.integers(0, 4, size=(600, 3)).astype(float)
    corpus[::3] = 1.0
    questions = np.vstack([random.integers(0, 4, size=(40, 3)), np.ones((20, 3))]).astype(float)
    assert found(spark, corpus, questions, 5, way) == brute(corpus, questions, 5)


@pytest.mark.parametrize("way", WAYS)
def test_far_from_the_origin_and_clustered(spark, way):
    random = np.random.default_rng(3)
    centres = random.normal(size=(6, 4)) * 1000
    corpus = centres[random.integers(0, 6, 500)] + random.normal(size=(500, 4))
    questions = centres[random.integers(0, 6, 60)] + random.normal(size=(60, 4))
    assert found(spark, corpus, questions, 4, way) == brute(corpus, questions, 4)


@pytest.mark.parametrize("way", WAYS)
def test_fewer_vectors_than_k_and_rows_without_vector(spark, way):
    corpus = np.array([[0.0, 0.0], [3.0, 4.0]])
    questions = asked(spark, np.array([[0.0, 0.0]])).union(
        spark.createDataFrame([(7, None)], QUESTIONS)
    )
    with_null = vectors(spark, corpus).union(spark.createDataFrame([("c9", None)], SCHEMA))
    rows = nearest(with_null, questions, 5, **WAYS[way]).collect()
    got = [(r.question_id, r["rank"], r.chunk_id, r.distance) for r in rows]
    assert sorted(got) == [(0, 1, "c00000", 0.0), (0, 2, "c00001", 25.0)]


@pytest.mark.parametrize("way", WAYS)
def test_empty_sides(spark, way):
    one = np.ones((1, 2))
    assert found(spark, np.empty((0, 2)), one, 3, way) == set()
    assert found(spark, one, np.empty((0, 2)), 3, way) == set()


@pytest.mark.parametrize("way", WAYS)
def test_bad_elements_take_no_part(spark, way):
    random = np.random.default_rng(4)
    corpus, questions = random.normal(size=(200, 3)), random.normal(size=(20, 3))
    bad = [("a1", [float("nan"), 0.0, 0.0]), ("a2", [float("inf"), 0.0, 0.0]), ("a3", [0.0, None, 0.0])]
    asking = [(100, [float("-inf"), 0.0, 0.0]), (101, [None, 1.0, 1.0])]
    hits = nearest(
        vectors(spark, corpus).union(spark.createDataFrame(bad, SCHEMA)),
        asked(spark, questions).union(spark.createDataFrame(asking, QUESTIONS)), 3, **WAYS[way],
    )
    got = {(r.question_id, r["rank"], r.chunk_id) for r in hits.collect()}
    assert got == brute(corpus, questions, 3)


def partial_hits(spark, corpus, questions, k):
    return _partial_hits(
        corpus, asked(spark, questions), k, "chunk_id", "question_id", "embedding", 64 << 20
    )


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """80,000 vectors, far more in a task than the bounds are seeded from; a third are one vector."""
    random = np.random.default_rng(5)
    corpus = random.normal(size=(80_000, 16)).astype(np.float32)
    corpus[::3] = 0.25
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    table = pa.table({"chunk_id": [f"c{i:05d}" for i in range(len(corpus))], "embedding": list(corpus)})
    spark.createDataFrame(table, SCHEMA).repartition(32).write.parquet(path)
    return corpus, spark.read.parquet(path)


def test_rows_emitted_follow_the_questions_and_not_the_tasks(spark, large):
    corpus, stored = large
    random = np.random.default_rng(6)
    # Some ask beside the repeated vector, where a third of the corpus ties.
    questions = np.vstack([random.normal(size=(40, 16)), 0.25 + 0.01 * random.normal(size=(10, 16))])
    for tasks in (8, 32):
        partial = partial_hits(spark, stored.repartition(tasks), questions, 5)
        assert partial.count() <= 3 * len(questions) * 5
    hits = nearest(stored.repartition(32), asked(spark, questions), 5)
    got = {(r.question_id, r["rank"], r.chunk_id) for r in hits.collect()}
    assert got == brute(corpus, questions, 5)


@pytest.mark.parametrize("rows", [0, 1, 8192, 8193, 80_000, 10**9])
def test_shares_are_the_whole_table_in_growing_steps(rows):
    steps = growing_shares(rows)
    assert steps[0][0] == 0.0 and steps[-1][1] == 1.0
    assert all(a[1] == b[0] for a, b in zip(steps, steps[1:]))
    assert steps[0][1] * rows <= 4 * SEED_ROWS
    assert all(high <= 4 * low for low, high in steps[1:]) and (len(steps) == 1 or steps[-1][0] == 0.5)


def test_a_task_holds_the_questions_once_and_one_block_of_distances():
    random = np.random.default_rng(8)
    asked = pa.array(list(random.normal(size=(20_000, 64)).astype(np.float32)), pa.list_(pa.float32()))
    corpus = pa.array(list(random.normal(size=(5_000, 64)).astype(np.float32)), pa.list_(pa.float32()))
    questions, ids = N._matrix(asked), np.array([f"c{i:05d}" for i in range(5_000)], object)
    assert questions.dtype == np.float32
    tracemalloc.start()
    try:
        # Bounds that little comes below, as those from the sample are.
        N._Best(questions, 5, np.full(20_000, 40.0), np.full(20_000, "")).add(ids, N._matrix(corpus))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * 8 * N.BLOCK_CELLS


def test_batches_are_counted_by_all_that_a_task_holds(spark):
    wide = asked(spark, np.zeros((50, 64)))
    held = 2 * 4 * 64 + 64 * 3  # as sent, as a matrix, and id and bounds
    assert N._question_bytes(wide, "embedding") >= 50 * held
