"""Centroid clustering (12) with Ptolemaic pivots.

For points x, c and pivots p, s Ptolemy's inequality gives
|xc| >= ||xp| * |cs| - |xs| * |cp|| / |ps|. A vector's distances to the pivots never change, so they are
stored beside it once; in a round a task needs only the centroids' distances to the pivots to bound
each distance from below. A vector is compared with the centroid of the least bound, and then
with those whose bound, rounded down, does not exceed what that gave. Distances are whole numbers
and sums are exact, so the result is that of comparing everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bit_slices import quantised
from lectern.llm.common import stored

#: Pivots are so many of the first centroids, far from each other; all their pairs give bounds.
PIVOTS = 6
#: A bound is lowered by this share of its terms, far more than its rounding.
ROUNDING = 1e-12
#: Distances that a task holds at a time.
BLOCK_CELLS = 1 << 20
#: Sums below this are whole in double precision.
WHOLE = 1 << 53
SCHEMA = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, row by row."""
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


def all_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``a`` to each row of ``b``."""
    most = max(int(np.abs(m).max()) if m.size else 0 for m in (a, b))
    if 4 * most * most * a.shape[1] < WHOLE:
        x, y = a.astype(np.float64), b.astype(np.float64)
        norms = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :]
        return (norms - 2.0 * (x @ y.T)).astype(np.int64)
    return np.stack([squares(a, row[None, :]) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


class PivotPairs:
    """The pivots (integer rows) and the pairs of them that are apart."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS) -> None:
        chosen, nearest = [0], None
        while len(chosen) < min(most, len(candidates)):
            last = all_squares(candidates, candidates[chosen[-1:]])[:, 0]
            nearest = last if nearest is None else np.minimum(nearest, last)
            chosen.append(int(nearest.argmax()))
        self.points = candidates[list(dict.fromkeys(chosen))]
        apart = np.sqrt(all_squares(self.points, self.points).astype(np.float64))
        self.pairs = [(p, s, apart[p, s]) for p, s in combinations(range(len(self.points)), 2) if apart[p, s] > 0]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(all_squares(vectors, self.points).astype(np.float64))

    def least_squares(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Numbers that no squared distance lies below, from the distances to the pivots."""
        bound = np.zeros((len(x), len(c)))
        for p, s, apart in self.pairs:
            one, other = x[:, p, None] * c[None, :, s], x[:, s, None] * c[None, :, p]
            lowered = np.abs(one - other)
            one += other
            one *= ROUNDING
            lowered -= one
            lowered /= apart
            np.maximum(bound, lowered, out=bound)
        return bound * bound * (1 - ROUNDING)


def nearest_centroids(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pairs: PivotPairs) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and how many distances were computed."""
    of_centroids = pairs.distances(centroids)
    number, distance = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64)
    step, compared = max(1, BLOCK_CELLS // len(centroids)), 0
    for start in range(0, len(vectors), step):
        block = vectors[start : start + step]
        least = pairs.least_squares(to_pivots[start : start + step], of_centroids)
        first = least.argmin(axis=1)
        found = squares(block, centroids[first])
        exact = np.full(least.shape, np.iinfo(np.int64).max)
        exact[np.arange(len(block)), first] = found
        open_ = least <= found[:, None]
        open_[np.arange(len(block)), first] = False
        rows, columns = np.nonzero(open_)
        for low in range(0, len(rows), step):
            part = slice(low, low + step)
            exact[rows[part], columns[part]] = squares(block[rows[part]], centroids[columns[part]])
        number[start : start + step] = exact.argmin(axis=1)
        distance[start : start + step] = exact.min(axis=1)
        compared += len(block) + len(rows)
    return number, distance, compared


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def first_centroids(points: DataFrame, rows: int, k: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of ``seed:id``, in that order.

    Only hashes below a threshold, which about 4 ``k`` rows meet, go on; it is raised if fewer than ``k`` do.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    share = min(1.0, 4 * k / max(1, rows))
    while True:
        some = points.withColumn("_hash", hashed)
        if share < 1.0:
            some = some.where(F.col("_hash") < f"{int(share * 16**13):013x}")
        found = some.orderBy(F.col("_hash").asc_nulls_last(), "v").limit(k).select("v").toArrow()
        if found.num_rows == k or share == 1.0:
            return np.array(found["v"].to_pylist(), np.int64)
        share = min(1.0, 8 * share)


def _with_pivots(points: DataFrame, pairs: PivotPairs, width: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pairs.distances(_vectors(batch["v"], width))
            yield batch.append_column("far", pa.FixedSizeListArray.from_arrays(far.ravel(), far.shape[1]).cast(pa.list_(pa.float64())))

    return points.mapInArrow(measure, "id long, v array<long>, far array<double>")


def _sums(points: DataFrame, centroids: np.ndarray, pairs: PivotPairs) -> tuple[np.ndarray, np.ndarray]:
    """Number and componentwise sum of each centroid's vectors, added up by Spark from one row per task and centroid."""
    k, width = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            vectors = _vectors(batch["v"], width)
            number, _, _ = nearest_centroids(vectors, _vectors(batch["far"], len(pairs.points)), centroids, pairs)
            order = np.argsort(number, kind="stable")
            present, starts = np.unique(number[order], return_index=True)
            if len(present):
                sums[present, :width] += np.add.reduceat(vectors[order], starts, axis=0)
                sums[present, width] += np.diff(np.append(starts, len(order)))
        held = np.flatnonzero(sums[:, width])
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    added = (
        points.mapInArrow(assign, "cluster int, sums array<long>")
        .select("cluster", F.posexplode("sums").alias("place", "value"))
        .groupBy("cluster", "place").agg(F.sum("value").alias("value")).toArrow()
    )
    sums = np.zeros((k, width + 1), np.int64)
    sums[np.asarray(added["cluster"]), np.asarray(added["place"])] = np.asarray(added["value"])
    return sums[:, width], sums[:, :width]


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, width: int = 64, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector's cluster after ``rounds`` rounds of k-means on floor(scale * x).

    Gives the id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``. Centroids start as the vectors of the ``k`` smallest hashes of their ids, all
    of them if there are fewer; equal hashes (repeated ids) go by vector, null ids come last. A
    centroid becomes the floor of its vectors' mean; one without vectors stays. Ties go to the smaller
    number. Vectors that are null, not of ``width`` components, or with a null or non-finite one
    take no part; repeated rows count each; extra columns are ignored; an empty table gives no rows.
    Sums of components and squared distances must fit 63 bits. To the driver go the centroids and their sums.
    """
    spark = vectors.sparkSession
    kept = F.col(vector_col).isNotNull() & (F.size(vector_col) == width)
    integers: Column = F.when(kept, quantised(F.col(vector_col), scale))
    points = vectors.select(F.col(id_col).cast("long").alias("id"), integers.alias("v")).where(F.col("v").isNotNull())
    centroids = first_centroids(points, points.count(), k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} long, {SCHEMA}")
    pairs = PivotPairs(centroids)
    points = stored(_with_pivots(points, pairs, width), "pivot-distances")
    for _ in range(rounds):
        counts, sums = _sums(points, centroids, pairs)
        moved = counts > 0
        centroids = centroids.copy()
        centroids[moved] = sums[moved] // counts[moved, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _ = nearest_centroids(
                _vectors(batch["v"], width), _vectors(batch["far"], len(pairs.points)), centroids, pairs
            )
            yield pa.record_batch([batch["id"], pa.array(number), pa.array(distance)], names=["id", "cluster", "distance"])

    assigned = stored(points.mapInArrow(assign, "id long, cluster int, distance long"), "assigned")
    inertias = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    told = [
        (c, total, sum(inertias.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, total in sorted(inertias.items())
    ]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
