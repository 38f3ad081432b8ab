"""Token counts (10) from the pieces of each distinct pre-token, and token ids.

A pre-token here is a run between spaces. A tokenizer that drops white space has no piece that goes
over such a border, so a text's tokens are those of its pre-tokens one after the other. The distinct
pre-tokens of all texts are a table; each is given to the library once. Their counts are joined to the
frequencies of the pre-tokens in each document and summed; ids are never made. The most frequent
ones, a bounded list that covers most of any text, go to the texts; the pairs of a document and
a rarer pre-token go to the table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sliced, stored

#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 1_000_000
#: The most frequent pre-tokens whose counts go to every task, a few megabytes.
FREQUENT = 200_000
#: Pre-tokens given to the library at a time.
ENCODED_AT_ONCE = 20_000


def load_tokenizer(path: str):
    """The tokenizer of a .json file; work is spread by Spark, not by the library's threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceCounts:
    """Pieces of a text as the library counts them."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = True  # this library joins pieces over spaces: a text is its own pre-token
            self.count = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
        else:
            library = load_tokenizer(path)
            library.no_truncation()
            library.no_padding()
            # A tokenizer that keeps white space has pieces over spaces: a text is its own pre-token.
            self.whole = len(library.encode(" \t\r\n", add_special_tokens=False).ids) > 0
            self.count = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: pa.Array) -> np.ndarray:
        listed = texts.fill_null("").to_pylist()
        some = (listed[i : i + ENCODED_AT_ONCE] for i in range(0, len(listed), ENCODED_AT_ONCE))
        return np.array([n for part in some for n in self.count(part)], np.int64)


_KNOWN: dict[str, PieceCounts] = {}


def _known(path: str) -> PieceCounts:
    """One library for all tasks of a Python worker."""
    if path not in _KNOWN:
        _KNOWN[path] = PieceCounts(path)
    return _KNOWN[path]


def pre_tokens(texts: pa.Array) -> pa.ListArray:
    """Each text cut at spaces, tabs and line ends; other white space stays inside a pre-token,
    where the library itself deals with it."""
    spaced = pc.replace_substring_regex(texts.fill_null(""), pattern="[\n\t\r]", replacement=" ")
    return pc.split_pattern(spaced, " ")


def piece_table(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(``piece``, ``uses``, ``n``) of each distinct pre-token of ``text``: how often it comes, and its pieces."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(uses.keys(), pa.string()), pa.array(uses.values(), pa.int64())], names=["piece", "uses"])

        for batch in batches:
            for part in sliced(batch, "text"):
                found = pre_tokens(part.column("text")).flatten().value_counts()
                for piece, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                    uses[piece] = uses.get(piece, 0) + n
                if len(uses) >= HELD:
                    yield told()
                    uses.clear()
        yield told()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("n", pa.array(_known(tokenizer).of(batch.column("piece"))))

    every = texts.select("text").mapInArrow(distinct, "piece string, uses long").groupBy("piece").agg(F.sum("uses").alias("uses"))
    return every.mapInArrow(count, "piece string, uses long, n long")


def _joined(texts: DataFrame, frequent: pa.Table) -> DataFrame:
    """Per document a row with the tokens of its frequent pre-tokens, and a row for each rarer ``piece`` of it
    with how often it comes; ``row`` says whose."""
    pieces = frequent["piece"].combine_chunks()
    counts = np.append(np.asarray(frequent["n"], np.int64), 0)  # the last one: not a frequent piece
    kind = texts.schema["id"].dataType.simpleString()
    names = ["row", "id", "n_bytes", "n", "piece"]

    def rare(rows: np.ndarray, words: pa.Array, types: list[pa.DataType]) -> pa.RecordBatch:
        coded = words.dictionary_encode()
        pairs, n = np.unique(np.stack([rows, np.asarray(coded.indices, np.int64)]), axis=1, return_counts=True)
        nothing = [pa.nulls(len(n), t) for t in types]
        return pa.record_batch([pa.array(pairs[0]), *nothing, pa.array(n, pa.int64()), coded.dictionary.take(pa.array(pairs[1]))], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in sliced(batch, "text"):
                lists = pre_tokens(part.column("text"))
                words, ends = lists.flatten(), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
                found = pc.index_in(words, value_set=pieces).fill_null(-1).to_numpy()
                sums = np.concatenate([[0], np.cumsum(counts[found])])
                rows = at + np.arange(part.num_rows)
                at += part.num_rows
                own = [part.column("id"), part.column("n_bytes")]
                totals = pa.array(sums[ends[1:]] - sums[ends[:-1]])
                yield pa.record_batch([pa.array(rows), *own, totals, pa.nulls(len(rows), pa.string())], names=names)
                left = np.flatnonzero(found < 0)
                if len(left):
                    of = rows[np.searchsorted(ends, left, side="right") - 1]
                    yield rare(of, words.take(pa.array(left)), [c.type for c in own])

    return texts.mapInArrow(join, f"row long, id {kind}, n_bytes long, n long, piece string")


def _counts_of_texts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """For tokenizers whose pieces go over spaces: each text is its own pre-token and counted where it is."""
    kind = texts.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                n = pa.array(_known(tokenizer).of(part.column("text")))
                yield pa.record_batch([part.column("id"), part.column("n_bytes"), n], names=["id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    The texts are read twice: for the distinct pre-tokens, and for their frequencies in each
    document. A null text is empty: 0 bytes, 0 tokens. Repeated rows give repeated results, a null id stays
    null, extra columns are ignored, and an empty table gives an empty result.
    """
    text: Column = F.col(text_col)
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    if PieceCounts(tokenizer).whole:
        counted = _counts_of_texts(texts, tokenizer)
    else:
        pieces = stored(piece_table(texts, tokenizer), "piece-counts")
        frequent = pieces.orderBy(F.col("uses").desc(), "piece").limit(FREQUENT).select("piece", "n").toArrow()
        joined = stored(_joined(texts, frequent), "document-pieces")
        counted = joined.where("piece IS NULL").select("row", "id", "n_bytes", "n")
        pairs = joined.where("piece IS NOT NULL")
        if not pairs.isEmpty():
            each = pairs.select("row", "piece", F.col("n").alias("times")).join(pieces, "piece")
            rare = each.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rare"))
            counted = counted.join(rare, "row", "left").withColumn("n", F.col("n") + F.coalesce("rare", F.lit(0)))
        counted = counted.select("id", "n_bytes", F.col("n").alias("n_tokens"))
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
