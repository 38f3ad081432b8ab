"""The stages of the corpus pipeline: each takes documents and returns what it keeps of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, mixing, near_dups, packing, substrings
from lectern.llm.common import settled, small_batches, stored, words_in


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Columns of the documents table.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def with_other_columns(stage: Stage) -> Stage:
    """``stage`` on the document columns, any others being carried along whatever their names, with
    Arrow batches of bounded size."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        small_batches(spark)
        others = [c for c in docs.columns if c not in DOCUMENT]
        if not others:
            return stage(spark, docs, folder)
        packed = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("_others")
        out = stage(spark, docs.select(*DOCUMENT, packed), folder)
        back = {c: F.col(f"_others.c{i}").alias(c) for i, c in enumerate(others)}
        return out.select(*(back.get(c, F.col(c)) for c in docs.columns))

    return run


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe join on ``keys``, which ``right`` loses."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(other, same, how).drop(*(f"_right_{k}" for k in keys))


@with_other_columns
def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is known; texts without letters, null ones included, go."""
    model = language.fit_text_model(docs, "text", "lang", max_rows=20_000)
    version = F.xxhash64("text")
    keys = ["doc_id", "_version", "lang", "source"]
    rows = docs.select("doc_id", version.alias("_version"), "lang", "source", "text")
    decided = language.identified(rows, model, keys, "text", "lang", "source")
    rejected = settled(lambda: decided.where("NOT accepted").select(keys).distinct(), "rejected", spark)
    return _joined(docs.withColumn("_version", version), rejected, keys, "left_anti").drop("_version")


@with_other_columns
def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; of the rows that repeat an
    id, the one with the smallest hash of its text. A null id is linked with nothing."""
    decided = settled(lambda: near_dups.near_duplicates(docs, width=5, percent=80), "near-decisions", spark)
    others = stored(decided.where("NOT kept").select("doc_id").distinct(), "near-copies")
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    repeated = decided.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    repeated = stored(repeated.select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("_order"))
    one = again.groupBy("doc_id").agg(F.min_by("row", "_order").alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)


@with_other_columns
def without_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without repeated passages, ``n_chars`` being counted anew; a text of which nothing is left goes.

    A null or empty text, of which nothing was cut, stays. Rows that repeat an id with the same text stay
    alike; a null id ranks last."""
    cut = substrings.without_repeats(docs)
    emptied = (F.size("removed") > 0) & (words_in(F.col("text")) == 0)
    return cut.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _taken(docs: DataFrame) -> DataFrame:
    sizes = mixing.document_sizes(docs)
    copies = mixing.rounded_copies(sizes, mixing.source_targets(sizes, (5, 2, 1), most=3.0))
    size, times = F.col("size").alias("_size"), F.col("copies").alias("_copies")
    return copies.where("copies > 0").select(F.col("id").alias("doc_id"), "source", size, times)


@with_other_columns
def mixed_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A text without words, null ones included, adds nothing to a mix and is taken like the others of its
    source by whole times only. A null source is a source of its own, the last one; rows that repeat
    id, source and size share one decision."""
    taken = settled(lambda: _taken(docs), "copies", spark)
    sized = docs.withColumn("_size", words_in(F.col("text")))
    repeated = _joined(sized, taken, ["doc_id", "source", "_size"], "inner")
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens.

    A null text counts as empty and takes the place of its end id; repeated rows are packed each."""
    small_batches(spark)
    vocabulary, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    return packing.packed_documents(docs, vocabulary, ranks, capacity=1024, end_id=2)
