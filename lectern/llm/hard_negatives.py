"""Hard-negative mining (13) by a secondary sort.

Pair scores are packed into byte keys (anchor, descending score, id), moved and sorted by
``repartitionAndSortWithinPartitions``. An iterator then reads an anchor's rows from the best score
down: a row of its own label opens the window of scores that its negatives may have, a row of
another label is given out for every open window it lies in, and nothing of an anchor is held but its
few windows.

Only pairs that can matter are packed. Each task compares blocks of rows with all anchors of a batch and
keeps, for each window, rows that can be among its first; the table is read in growing shares, so
that every share knows the last place that the shares before it leave open (``growing_shares``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bit_slices import padded, quantised
from lectern.llm.common import stored
from lectern.operators.ordering import first_rows
from lectern.operators.shares import growing_shares, share_of

#: Bytes of anchor vectors that go to the tasks at once; more anchors make more passes.
ANCHOR_BYTES = 32 << 20
#: Scores that a task holds at a time, and rows of a block.
BLOCK_CELLS, BLOCK_ROWS = 1 << 21, 4096
#: Anchors whose rows one task sorts, about.
ANCHORS_IN_TASK = 2_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Anchor number, anchor id, inverted score, kind (0: own label), id, place of the row.
KEY = ">IQQBQQ"
SIGN = 1 << 63
HIT = "window long, score long, id long, place long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


@dataclass
class Windows:
    """For each window its anchor's number (ascending), the scores it takes, and whether it is for rows of the anchor's label."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own_label: bool
    k: int


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices, of any two widths."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = [float(np.abs(m).max()) if m.size else 0.0 for m in (a, b)]
    if most[0] * most[1] * width < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class TopOfWindows:
    """The ``k`` first rows (highest score, then smallest id) of each window seen so far in a task."""

    def __init__(self, anchors: Anchors, windows: Windows, score: np.ndarray, ident: np.ndarray) -> None:
        self.anchors, self.windows = anchors, windows
        #: Rows behind this place are not among the first, as others are known already.
        self.score, self.ident = score.copy(), ident.copy()
        self.held = tuple(np.empty(0, np.int64) for _ in range(4))

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, places: np.ndarray) -> None:
        windows, found = self.windows, [self.held]
        step = max(1, BLOCK_CELLS // len(ids))
        for start in range(0, len(windows.anchor), step):
            part = slice(start, start + step)
            anchor = windows.anchor[part]
            low = int(anchor[0])
            scores = products(self.anchors.vectors[low : int(anchor[-1]) + 1], vectors)[anchor - low]
            open_ = scores >= np.maximum(windows.low[part], self.score[part])[:, None]
            open_ &= scores <= windows.high[part][:, None]
            same = self.anchors.labels[anchor][:, None] == labels[None, :]
            open_ &= same if windows.own_label else ~same
            if windows.own_label:
                open_ &= self.anchors.ids[anchor][:, None] != ids[None, :]
            if windows.k < len(ids) and np.count_nonzero(open_) > 4 * windows.k * len(anchor):
                kth = np.partition(np.where(open_, scores, LEAST), len(ids) - windows.k, axis=1)[:, len(ids) - windows.k]
                open_ &= scores >= kth[:, None]
            w, r = np.nonzero(open_)
            score, ident = scores[w, r], ids[r]
            w = w + start
            kept = (score > self.score[w]) | (ident <= self.ident[w])
            found.append((w[kept], score[kept], ident[kept], places[r[kept]]))
        if len(found) > 1:
            self._keep(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def _keep(self, window: np.ndarray, score: np.ndarray, ident: np.ndarray, place: np.ndarray) -> None:
        order = np.lexsort((place, ident, -score, window))
        window, score, ident, place = (x[order] for x in (window, score, ident, place))
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        first, last = rank < self.windows.k, rank == self.windows.k - 1
        self.score[window[last]], self.ident[window[last]] = score[last], ident[last]
        self.held = tuple(x[first] for x in (window, score, ident, place))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer lists as rows, the shorter ones filled up with zeros."""
    lengths = pa.compute.unique(pa.compute.list_value_length(column)).to_pylist()
    if len(lengths) == 1:
        return np.asarray(pa.compute.list_flatten(column), np.int64).reshape(len(column), lengths[0])
    return padded([np.asarray(x.values, np.int64) for x in column], max(lengths))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for start in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(start, BLOCK_ROWS)
        yield np.asarray(part["id"]), np.asarray(part["label"]), _matrix(part["v"])


def _candidates(rows: DataFrame, anchors: Anchors, windows: Windows, score: np.ndarray, ident: np.ndarray) -> DataFrame:
    """From each task the rows that can be among the first of a window."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, place = TopOfWindows(anchors, windows, score, ident), TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, labels, vectors in _blocks(batch):
                top.add(ids, labels, vectors, place + np.arange(len(ids)))
                place += len(ids)
        yield pa.record_batch([pa.array(c) for c in top.held], names=["window", "score", "id", "place"])

    return rows.select("id", "label", "v").mapInArrow(search, HIT)


def _first_of_windows(rows: DataFrame, count: int, anchors: Anchors, windows: Windows) -> DataFrame:
    """Candidates of all rows; no window has more than ``k`` of those before the last share."""
    score, ident = np.full(len(windows.anchor), LEAST), np.full(len(windows.anchor), MOST)
    best = None
    for low, high in growing_shares(count):
        found = _candidates(share_of(rows, "id", low, high), anchors, windows, score, ident)
        if best is not None:
            found = found.unionByName(best.drop("_n"))
        if high < 1.0:
            best = stored(_ranked(found, windows.k), "window-rows")
            last = best.where(F.col("_n") == windows.k).toArrow()  # a row for each window
            at = np.asarray(last["window"])
            score[at], ident[at] = np.asarray(last["score"]), np.asarray(last["id"])
    return found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return first_rows(found, ["window"], [F.col("score").desc(), F.col("id"), F.col("place")], k, "_n")


def pack(number: int, anchor: int, score: int, own_label: bool, ident: int, place: int) -> bytes:
    """A key that sorts as (anchor, descending score, own label first, id)."""
    return struct.pack(KEY, number, anchor + SIGN, SIGN - 1 - score, not own_label, ident + SIGN, place)


def mined(keys: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows from the sorted keys of some anchors. A row that several windows asked for came more than once."""
    last, current, opened = None, None, []
    for key, _ in keys:
        if key == last:
            continue
        last = key
        number, anchor, inverted, other, ident, _ = struct.unpack(KEY, key)
        if number != current:
            current, opened, seen = number, [], 0
        score, ident = SIGN - 1 - inverted, ident - SIGN
        if not other:
            seen += 1
            if seen <= positives:
                opened.append([ident, score, 0])
            continue
        for window in opened:
            if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor - SIGN, window[0], window[2], ident, window[1], score


def _sorted_out(hits: DataFrame, anchors: int, partitions: int, negatives_per: tuple[int, int], percent: tuple[int, int]) -> DataFrame:
    """Hits (``number``, ``anchor``, ``own_label`` and those of ``HIT``) to result rows, by the secondary sort."""
    tasks = max(partitions, -(-anchors // ANCHORS_IN_TASK))
    keyed = hits.rdd.map(lambda r: (pack(r.number, r.anchor, r.score, r.own_label, r.id, r.place), None))
    by_anchor = keyed.repartitionAndSortWithinPartitions(tasks, lambda key: int.from_bytes(key[:4], "big"))
    rows = by_anchor.mapPartitions(lambda keys: mined(keys, *negatives_per, *percent))
    return hits.sparkSession.createDataFrame(rows, MINED, verifySchema=False)


def _numbered(found: DataFrame, anchors: Anchors, windows: Windows) -> DataFrame:
    """Hits with the number and id of their window's anchor."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = windows.anchor[np.asarray(batch["window"])]
            columns = [pa.array(number), pa.array(anchors.ids[number]), *(batch[c] for c in ("score", "id", "place"))]
            yield pa.record_batch(columns, names=["number", "anchor", "score", "id", "place"])

    named = found.select("window", "score", "id", "place").mapInArrow(name, "number long, anchor long, score long, id long, place long")
    return named.withColumn("own_label", F.lit(windows.own_label))


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each row that meets ``anchors`` and each of its first ``positives`` rows of the same label: the first
    ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive.

    The score is the inner product of floor(scale * x); higher come first, ties by smaller id. Gives
    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and
    ``negative_score``. A null id, label or vector, or a vector with a null or non-finite component,
    takes no part; a shorter vector counts as padded with zeros. Rows with the anchor's id are not
    its positives; other repeated rows count each, and a repeated anchor asks once. A positive that
    scores less than zero has no negatives. Extra columns are ignored; an empty table gives no rows.
    Scores times 100 must fit 63 bits. Anchors go to the tasks in batches of ``ANCHOR_BYTES``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        quantised(F.col(vector_col), scale).alias("v"), anchors.alias("asks"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = stored(rows, "whole-vectors")
    asking = rows.where("asks").select("id", "label", "v").distinct()
    told = rows.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("asks"), 8 * (F.size("v") + 2))).alias("bytes")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = -(-(told["bytes"] or 0) // ANCHOR_BYTES)
    out = []
    for i in range(batches):
        table = asking.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i).orderBy("id", "label", "v").toArrow()
        if not table.num_rows:
            continue
        batch = Anchors(np.asarray(table["id"]), np.asarray(table["label"]), _matrix(table["v"]))
        out.append(_mined_batch(rows, told["rows"], batch, partitions, (positives, negatives), (low, high)))
    if not out:
        return spark.createDataFrame([], MINED)
    mined_rows = out[0]
    for more in out[1:]:
        mined_rows = mined_rows.unionByName(more)
    return mined_rows


def _mined_batch(rows: DataFrame, count: int, anchors: Anchors, partitions: int, per: tuple[int, int], percent: tuple[int, int]) -> DataFrame:
    every = np.arange(len(anchors.ids))
    any_score = np.full(len(every), LEAST), np.full(len(every), MOST)
    own = Windows(every, *any_score, True, per[0])
    best = stored(_ranked(_first_of_windows(rows, count, anchors, own), per[0]).drop("_n"), "positives")

    scored = best.select("window", "score").orderBy("window", F.col("score").desc()).toArrow()  # a few for each anchor
    number, score = np.asarray(scored["window"]), np.asarray(scored["score"])
    least, most = -(-percent[0] * score // 100), percent[1] * score // 100
    some = least <= most
    hits = _numbered(best, anchors, own)
    if some.any():
        others = Windows(number[some], least[some], most[some], False, per[1])
        hits = hits.unionByName(_numbered(_first_of_windows(rows, count, anchors, others), anchors, others))
    return _sorted_out(stored(hits, "pairs"), len(every), partitions, per, percent)
