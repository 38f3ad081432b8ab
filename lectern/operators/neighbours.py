"""Exact k nearest neighbours by squared L2 for whole tables of question vectors.

Distances are never materialised as row pairs. Questions go to the tasks in batches of a measured
size, however many there are; for each batch the corpus is scanned in place, without any shuffle of
it, in growing shares. A task compares blocks of vectors and emits its best rows per question, and
only those that can still win: the first share starts from a small sample, and every other from the
k-th neighbour (distance and id) in the shares before it. A window merges the tasks' rows after
each share. So the last share, half of the corpus, adds about k rows per question however many tasks
and rows there are, and vectors that tie with the k-th add none.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.cluster import cut_lineage
from lectern.fixed_values import TOP_K
from lectern.operators.ordering import first_rows
from lectern.operators.shares import growing_shares, seed_sample, share_of

BATCH_BYTES = 64 << 20
BLOCK_CELLS = 1 << 22
# What a task holds of a question besides its vector: id, norm, and the k-th best distance and id.
QUESTION_BYTES = 256
# Distances of the same two vectors on different machines differ by less than this share.
ROUNDING = 1e-12


def _matrix(column) -> np.ndarray:
    """Arrow list column to an (n, d) matrix, of 32 bits where the column is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.to_pylist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.float32 if pa.types.is_float32(column.type.value_type) else np.float64)
    return flat.reshape(len(column), lengths[0].as_py() if len(lengths) else 0)


def _block_pairs(q, q_norm, o, o_norm, k, bound):
    """Index pairs that may be among the k nearest of this block, with exact distances.

    The product form finds candidates; its rounding error is covered by ``slack`` and the kept
    pairs are measured again by differences, so equal vectors get equal distances.
    """
    coarse = q @ o.T
    coarse *= -2.0  # in place, as this is the largest array of a task
    coarse += q_norm[:, None]
    coarse += o_norm
    slack = 1e-9 * (q_norm + (o_norm.max() if len(o_norm) else 0.0)) + 1e-30
    near = coarse <= (bound + 2.0 * slack)[:, None]
    # Later blocks have few rows below the bound; only a crowded one needs its own k-th best.
    if o.shape[0] > k and np.count_nonzero(near) > 2 * k * len(q):
        kth = np.partition(coarse, k - 1, axis=1)[:, k - 1]
        near = coarse <= (np.minimum(bound, kth) + 2.0 * slack)[:, None]
    qi, oi = np.nonzero(near)
    step = max(1, BLOCK_CELLS // max(1, q.shape[1]))
    distance = np.empty(len(qi))
    for start in range(0, len(qi), step):
        part = slice(start, start + step)
        difference = q[qi[part]] - o[oi[part]]
        distance[part] = np.einsum("ij,ij->i", difference, difference)
    return qi, oi, distance


def _k_best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.sort_values(["q", "d", "id"])
    return rows[rows.groupby("q").cumcount() < k]


class _Best:
    """The k best (distance, id) per question seen so far in a task.

    ``bound`` and ``bound_id`` are the k-th best known from elsewhere: rows behind them can't win.
    The questions stay as they came; those of one block are widened to 64 bits at a time.
    """

    def __init__(self, questions: np.ndarray, k: int, bound=None, bound_id=None):
        self.q, self.k = questions, k
        self.norm = np.einsum("ij,ij->i", questions, questions, dtype=np.float64)
        self.bound = np.full(len(questions), np.inf) if bound is None else bound.copy()
        self.bound_id = np.full(len(questions), None) if bound_id is None else bound_id.copy()
        self.rows = pd.DataFrame({"q": np.empty(0, int), "d": np.empty(0), "id": []})

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compare a block of the corpus, at most ``BLOCK_CELLS`` distances at a time."""
        for start in range(0, len(ids), BLOCK_CELLS):
            part = slice(start, start + BLOCK_CELLS)
            self._add_block(ids[part], vectors[part])

    def _can_win(self, q, d, ids):
        bound = self.bound[q]
        kept = d <= bound * (1 + ROUNDING)
        tied = np.flatnonzero(d == bound)
        last = self.bound_id[q[tied]]
        kept[tied] = [a is None or b is None or a <= b for a, b in zip(ids[tied], last)]
        return kept

    def _add_block(self, ids, vectors):
        if not len(self.q):
            return
        vectors = vectors.astype(np.float64)
        o_norm = np.einsum("ij,ij->i", vectors, vectors)
        step = max(1, BLOCK_CELLS // len(ids))
        found = [self.rows] if len(self.rows) else []
        for start in range(0, len(self.q), step):
            part = slice(start, start + step)
            asked = self.q[part].astype(np.float64)
            qi, oi, d = _block_pairs(
                asked, self.norm[part], vectors, o_norm, self.k, self.bound[part]
            )
            qi = qi + start
            kept = self._can_win(qi, d, ids[oi])
            if kept.any():
                found.append(
                    _k_best(pd.DataFrame({"q": qi[kept], "d": d[kept], "id": ids[oi[kept]]}), self.k)
                )
        if not found:
            return
        self.rows = _k_best(pd.concat(found, ignore_index=True), self.k)
        last = self.rows[self.rows.groupby("q").cumcount() == self.k - 1]
        q, d, ids = (last[c].to_numpy() for c in ("q", "d", "id"))
        nearer = self._can_win(q, d, ids)
        self.bound[q[nearer]], self.bound_id[q[nearer]] = d[nearer], ids[nearer]


def _hit_schema(corpus, questions, id_col, question_col):
    return T.StructType(
        [
            T.StructField(question_col, questions.schema[question_col].dataType),
            T.StructField(id_col, corpus.schema[id_col].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _as_batch(question_ids, rows: pd.DataFrame, question_col, id_col, types) -> pa.RecordBatch:
    q_type, id_type = types
    if not len(rows):
        question_ids, rows = np.empty(0, object), rows.astype({"id": object})
    return pa.RecordBatch.from_arrays(
        [
            pa.array(question_ids[rows["q"].to_numpy()], type=q_type),
            pa.array(rows["id"].to_numpy(), type=id_type),
            pa.array(rows["d"].to_numpy(), type=pa.float64()),
        ],
        names=[question_col, id_col, "distance"],
    )


def _search(corpus, batch, k, columns, schema, bounds):
    """Rows of ``corpus`` that may be among the k nearest of the batch's questions."""
    id_col, question_col, vector = columns
    question_ids, matrix, q_type = batch

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = _Best(matrix, k, *bounds), None
        for block in rows:
            id_type = block[id_col].type
            best.add(block[id_col].to_numpy(zero_copy_only=False), _matrix(block[vector]))
        if len(best.rows):
            yield _as_batch(question_ids, best.rows, question_col, id_col, (q_type, id_type))

    return corpus.mapInArrow(search, schema)


def _kth(best, question_ids, k, id_col, question_col):
    """The k-th best of each question, a row or none each: at most one row per question of a batch."""
    last = best.where(F.col("_n") == k).select(question_col, "distance", id_col).toPandas()
    last = last.drop_duplicates(question_col).set_index(question_col).reindex(question_ids)
    known = last["distance"].notna().to_numpy()
    ids = np.full(len(question_ids), None)
    ids[known] = last[id_col].to_numpy()[known].astype(object)
    return np.where(known, last["distance"].to_numpy(), np.inf), ids


def _batch_hits(corpus, batch, sample, steps, k, columns, schema):
    """The batch's candidates after the last share; those of the shares before are down to k."""
    id_col, question_col, vector = columns
    question_ids, matrix, _ = batch
    seed = _Best(matrix, k)
    if sample.num_rows and len(matrix):
        seed.add(sample[id_col].to_numpy(), _matrix(sample[vector]))
    bounds, best = (seed.bound, seed.bound_id), None
    for low, high in steps:
        share = share_of(corpus, id_col, low, high)
        found = _search(share, batch, k, columns, schema, bounds)
        if best is not None:
            found = found.unionByName(best.drop("_n"))
        if high < 1.0:
            order = [F.col("distance"), F.col(id_col)]
            best = cut_lineage(first_rows(found, [question_col], order, k, "_n"))
            bounds = _kth(best, question_ids, k, id_col, question_col)
    return found


def _question_bytes(questions, vector):
    """What the questions take in a task: each vector as it was sent and as the matrix made of it."""
    width = 4 if isinstance(questions.schema[vector].dataType.elementType, T.FloatType) else 8
    size = F.size(vector).cast("long") * 2 * width + QUESTION_BYTES
    return questions.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0


def _partial_hits(corpus, questions, k, id_col, question_col, vector, batch_bytes):
    """Rows that may be among the k nearest, over all batches of questions."""
    batches = max(1, -(-_question_bytes(questions, vector) // max(1, batch_bytes)))
    rows = corpus.count()
    sample = seed_sample(corpus, id_col, rows).toArrow()
    schema = _hit_schema(corpus, questions, id_col, question_col)
    parts = []
    for number in range(batches):
        batch = questions
        if batches > 1:
            batch = questions.where(F.pmod(F.xxhash64(question_col), F.lit(batches)) == number)
        table = batch.toArrow()  # less than batch_bytes
        batch = table[question_col].to_numpy(), _matrix(table[vector]), table[question_col].type
        columns = (id_col, question_col, vector)
        parts.append(_batch_hits(corpus, batch, sample, growing_shares(rows), k, columns, schema))
    return reduce(DataFrame.unionByName, parts)


def _with_finite_vector(rows: DataFrame, vector: str) -> DataFrame:
    """A null or non-finite element has no distance to anything."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, finite))


def nearest(
    corpus: DataFrame, questions: DataFrame, k: int = TOP_K, id_col: str = "chunk_id",
    question_col: str = "question_id", vector: str = "embedding",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``(question_col, rank, id_col, distance)``: the k nearest rows, fewer if there are fewer.

    Rows whose vector is null or holds a null or non-finite element take no part, on either side.
    Ties go to the smaller id.
    """
    corpus = _with_finite_vector(corpus.select(id_col, vector), vector)
    questions = _with_finite_vector(questions.select(question_col, vector), vector)
    partial = _partial_hits(corpus, questions, k, id_col, question_col, vector, batch_bytes)
    return first_rows(
        partial, [question_col], [F.col("distance"), F.col(id_col)], k, "rank"
    ).select(question_col, "rank", id_col, "distance")
