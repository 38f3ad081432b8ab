"""Best-fit packing (3) planned on a histogram of lengths.

Documents are tokenised once into pieces. The plan sees only how many pieces have each length (at
most ``capacity`` numbers), and packs counts, not documents: best fit in decreasing order, a whole
class of equally full sequences at a time. Each length then has runs of planned slots, and a piece
takes the slot of its rank within its length.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import numbered, stored, text_slices
from lectern.llm.tokens import load_tokenizer

#: Texts whose UTF-8 bytes all lie below this (Latin script and punctuation) and hold no special
#: token are encoded from the ranks. Elsewhere the two libraries' Unicode tables could differ.
PLAIN_BELOW = 0xCA


class IdEncoder:
    """Ids as the tokenizer's own library gives them.

    With ``ranks``, the same vocabulary as ranks, plain texts are encoded several times faster. Both
    ways merge in the same order: in this vocabulary every token's own bytes encode to that token,
    so that the pair that makes a token is the only one left in its bytes when its rank comes up.
    """

    def __init__(self, path: str, ranks: str | None) -> None:
        self.library = load_tokenizer(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def plain(self, text: str) -> bool:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return data.size > 0 and int(data.max()) < PLAIN_BELOW and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if self.fast and self.plain(text):
                yield self.fast.encode_to_numpy(text, disallowed_special=())
            else:
                yield np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_KNOWN: dict[tuple[str, str | None], IdEncoder] = {}


def _known(path: str, ranks: str | None) -> IdEncoder:
    """One encoder for all tasks of a Python worker."""
    if (path, ranks) not in _KNOWN:
        _KNOWN[path, ranks] = IdEncoder(path, ranks)
    return _KNOWN[path, ranks]


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its tokens and ``end_id``. Up to ``capacity`` tokens it is one piece; a longer one
    is cut so that all pieces but the first are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(tokenizer, ranks)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(known.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                    for n, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append(row)
                        piece.append(n)
                        start.append(low)
                        length.append(high - low)
                        crc.append(zlib.crc32(ids[low:high].tobytes()))
                yield pa.record_batch(
                    [
                        part.column("id").take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: runs ``(length, rank_from, rank_to, sequence, each, offset)``.

    Ranks ``rank_from`` … ``rank_to`` - 1 of a length fill sequences from ``sequence`` on, ``each``
    of them side by side from ``offset``. Sequences of one class are equally full, so a step
    handles a class at once and its cost doesn't depend on how many documents there are.
    """
    open_by_room: dict[int, deque[tuple[int, int]]] = {}
    runs, made = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = min((r for r, held in open_by_room.items() if r >= length and held), default=None)
            if room is None:
                count = -(-left // (capacity // length))
                open_by_room.setdefault(capacity, deque()).append((made, count))
                made += count
                room = capacity
            first, count = open_by_room[room].popleft()
            each = min(room // length, left)
            take = min(count, left // each)
            runs.append((length, rank, rank + take * each, first, each, capacity - room))
            rank += take * each
            left -= take * each
            open_by_room.setdefault(room - each * length, deque()).append((first, take))
            if take < count:
                open_by_room[room].appendleft((first + take, count - take))
    return runs


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (with ``id``, ``piece`` and ``length``) with ``sequence_id`` and ``offset``.

    Only the histogram, at most ``capacity`` numbers, reaches the driver; the plan is a few thousand
    runs for any corpus and is joined on length and rank. ``pieces`` is read more than once.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan_slots(counts, capacity)
    plan = pieces.sparkSession.createDataFrame(
        runs or [(0, 0, 0, 0, 1, 0)],
        "run_length long, rank_from long, rank_to long, first_sequence long, each long, first_offset long",
    )
    ranked = numbered(pieces, ["length"], ["id", "piece", "start", "ids_crc32"], "rank")
    within = F.col("rank") - F.col("rank_from")
    slot = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(F.broadcast(plan), slot).select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (within % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document lies: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.

    A null or empty text is one piece of the end token alone. Repeated rows are packed each for
    itself, a null id stays null, extra columns are ignored, and an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, ranks, capacity, end_id, id_col, text_col)
    return pack(stored(pieces, "pieces"), capacity).withColumnRenamed("id", id_col)
