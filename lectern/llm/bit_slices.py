"""Exact top-k inner products (8) over a bit-sliced index.

Components are integers. A block of rows keeps, per component, one bitmap for each of the upper bits
of the value. For a question the slices of all components are added as bitmaps, weighted by
the bits of the question's components, which gives the slices of a coarse score of every row at
once. Going from the most significant slice downward finds the k-th largest coarse score; rows whose
possible score reaches it, the boundary included, are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored
from lectern.operators.ordering import first_rows
from lectern.operators.shares import growing_shares, share_of

#: Rows of an index block.
BLOCK_ROWS = 65_536
#: Bits kept of a component.
SLICE_BITS = 7
#: Bytes of question vectors that go to the tasks at once; more questions make more passes.
QUESTION_BYTES = 64 << 20


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class BitSlicedBlock:
    """Some rows (``ids``, integer ``values``) and their bitmaps."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.low = int(values.min()) if values.size else 0
        span = int(values.max()) - self.low if values.size else 0
        self.shift = max(0, span.bit_length() - SLICE_BITS)
        self.bits = max(1, span.bit_length() - self.shift)
        coarse = ((values - self.low) >> self.shift).T
        words = -(-len(ids) // 64)
        slices = np.zeros((2, self.bits, values.shape[1], words * 8), np.uint8)
        for bit in range(self.bits):
            packed = np.packbits((coarse >> bit) & 1, axis=1, bitorder="little")
            slices[0, bit, :, : packed.shape[1]] = packed
        # Negative weights add the complement, so that all sums stay positive.
        slices[1] = ~slices[0]
        self.slices = slices.view(np.uint64)
        valid = np.zeros(words * 8, np.uint8)
        valid[: -(-len(ids) // 8)] = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        self.valid = valid.view(np.uint64)

    def score_slices(self, question: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over |weight| * coarse value."""
        weights, signs = np.abs(question), (question < 0).astype(np.int64)
        columns: dict[int, list[np.ndarray]] = {}
        for place in range(int(weights.max()).bit_length() if weights.size else 0):
            dims = np.flatnonzero((weights >> place) & 1)
            if len(dims):
                for bit in range(self.bits):
                    columns.setdefault(place + bit, []).append(self.slices[signs[dims], bit, dims])
        out, place = [], 0
        while columns:
            held = columns.pop(place, None)
            stack = np.concatenate(held) if held else np.zeros((1, self.slices.shape[-1]), np.uint64)
            while len(stack) > 1:
                if len(stack) == 2:  # half adder
                    columns.setdefault(place + 1, []).append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
                    continue
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                either = a ^ b
                columns.setdefault(place + 1, []).append((a & b) | (c & either))
                stack = np.concatenate([either ^ c, stack[3 * third :]])
            out.append(stack[0])
            place += 1
        return out

    def top(self, question: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``k`` best rows that are not ``own``."""
        wanted = k + int((self.ids == own).sum())
        if len(self.ids) <= wanted:
            rows = np.arange(len(self.ids))
        else:
            slices = self.score_slices(question)
            least = kth_largest(slices, self.valid, wanted)
            # What was cut off a component adds less than 2 ** shift times its weight, either way.
            slack = -(-int(np.abs(question).sum()) * ((1 << self.shift) - 1) >> self.shift)
            chosen = at_least(slices, self.valid, least - slack)
            rows = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        rows = rows[self.ids[rows] != own]
        scores = self.values[rows] @ question
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def kth_largest(slices: list[np.ndarray], valid: np.ndarray, k: int) -> int:
    """The k-th largest number that the slices hold, found from the most significant one down."""
    above, level, value = np.zeros_like(valid), valid, 0
    for place in reversed(range(len(slices))):
        with_bit = level & slices[place]
        if int(np.bitwise_count(above | with_bit).sum()) >= k:
            level, value = with_bit, value | (1 << place)
        else:
            above, level = above | with_bit, level & ~slices[place]
    return value


def at_least(slices: list[np.ndarray], valid: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows whose number is ``value`` or more."""
    if value <= 0:
        return valid
    above, level = np.zeros_like(valid), valid
    for place in reversed(range(len(slices))):
        if value >> place & 1:
            level = level & slices[place]
        else:
            above, level = above | (level & slices[place]), level & ~slices[place]
    return above | level


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as integers; null where the vector takes no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    integers = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(vector.isNotNull() & whole, integers)


def top_inner_products(vectors: DataFrame, questions: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that meets ``questions``: the ``k`` other rows of the largest integer inner product.

    Gives ``query_id``, ``rank`` (from 1), the id and ``score``; ties go to the smaller id.
    Questions go to the tasks in batches of at most ``QUESTION_BYTES``, each against all rows in
    blocks, which are read in growing shares: of a share only rows go on that can still be among a
    question's ``k`` best of all shares so far. A vector that is null or holds a null
    or non-finite component takes no part, nor does a null id; a shorter vector counts as
    padded with zeros. Rows with the question's id are its own; other repeated rows count each.
    Extra columns are ignored; an empty table gives no rows. Scores must fit 63 bits.
    """
    integers = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), questions.alias("asks"))
    integers = stored(integers.where(F.col("id").isNotNull() & F.col("v").isNotNull()), "whole-vectors")
    asking = integers.where("asks").select("id", "v").distinct()
    size = asking.agg(F.sum(8 * (F.size("v") + 1)).alias("bytes")).first()["bytes"] or 0
    batches, rows = -(-size // QUESTION_BYTES) or 1, integers.count()
    found = None
    for i in range(batches):
        batch = asking.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i).toArrow()
        asked = np.asarray(batch.column("id")), [np.asarray(x.values, np.int64) for x in batch.column("v")]
        part = _candidates(integers.select("id", "v"), rows, asked, k)
        found = part if found is None else found.unionByName(part)
    return (
        first_rows(found, ["query_id"], [F.col("score").desc(), F.col("id")], k, "rank")
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _candidates(integers: DataFrame, rows: int, asked: tuple[np.ndarray, list[np.ndarray]], k: int) -> DataFrame:
    """Rows that can be among the ``k`` best of the batch's questions; those before the last share are down to ``k``.

    A question is known by its id: were an id asked for with several vectors, its bound is that of all.
    """
    ids = asked[0]
    least, last = np.full(len(ids), np.iinfo(np.int64).min), np.full(len(ids), np.iinfo(np.int64).max)
    best = None
    for low, high in growing_shares(rows):
        found = _search(share_of(integers, "id", low, high), asked, k, least, last)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        if high < 1.0:
            best = stored(first_rows(found, ["query_id"], [F.col("score").desc(), F.col("id")], k, "rank"), "best-so-far")
            known = best.where(F.col("rank") == k).toPandas().set_index("query_id").reindex(ids)
            has = known["score"].notna().to_numpy()
            least[has], last[has] = known["score"][has].astype(np.int64), known["id"][has].astype(np.int64)
    return found


def _search(integers: DataFrame, asked: tuple[np.ndarray, list[np.ndarray]], k: int, least: np.ndarray, last: np.ndarray) -> DataFrame:
    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in rows:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield _best(held, *asked, k, least, last)
                held, count = [], 0
        if count and len(asked[0]):
            yield _best(held, *asked, k, least, last)

    return integers.mapInArrow(search, "query_id long, id long, score long")


def _best(batches: list[pa.RecordBatch], ids: np.ndarray, vectors: list[np.ndarray], k: int, least: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """The block's best rows of each question that do not come after its place (``least`` score, ``last`` id)."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    lists = [np.asarray(x.values, np.int64) for x in rows.column("v")]
    width = max(map(len, [*lists, *vectors]))
    block = BitSlicedBlock(np.asarray(rows.column("id"), np.int64), padded(lists, width))
    best = []
    for i, question, score, ident in zip(ids, padded(vectors, width), least, last, strict=True):
        found, scores = block.top(question, int(i), k)
        kept = (scores > score) | ((scores == score) & (found <= ident))
        best.append((found[kept], scores[kept]))
    return pa.record_batch(
        [
            pa.array(np.repeat(ids, [len(b[0]) for b in best]), pa.int64()),
            pa.array(np.concatenate([b[0] for b in best]), pa.int64()),
            pa.array(np.concatenate([b[1] for b in best]), pa.int64()),
        ],
        names=["query_id", "id", "score"],
    )
