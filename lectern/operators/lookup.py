"""From nearest chunks to context blocks, sources and answer prompts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import text as X
from lectern.functions.model_text import request_payload
from lectern.operators.corpus import id_block
from lectern.operators.ordering import split_hot

# A hit row is an id pair, a rank and a distance; a million of them are well below 200 MB.
BROADCAST_HITS = 1_000_000
# A chunk with more hits than this is popular; there are at most hits / POPULAR_HITS of them, with
# texts of a chunk's length each.
POPULAR_HITS = 100_000
POPULAR_CHUNKS = 50_000
BLOCK = "id_block"


def _in_place(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join that moves the hits to the buckets of the stored chunks.

    Only the block is a join key, because the table is bucketed by the block alone; inside a block,
    which is a few chunks, ids are compared.
    """
    moved = hits.withColumnRenamed("chunk_id", "_id").withColumn("_block", id_block(F.col("_id")))
    same = (chunks["chunk_id"] <= moved["_id"]) & (chunks["chunk_id"] >= moved["_id"])
    return chunks.join(moved, (chunks[BLOCK] == moved["_block"]) & same).drop("_id", "_block")


def _from_store(hits: DataFrame, chunks: DataFrame, popular_hits: int) -> DataFrame:
    ordinary, popular = split_hot(hits, ["chunk_id"], popular_hits)
    found = _in_place(ordinary, chunks)
    if popular is None:
        return found
    ids = popular.select("chunk_id").distinct()
    # The few popular chunks are fetched once and go to their hits, which stay where they are.
    texts = _in_place(ids, chunks)
    few = ids.count() <= POPULAR_CHUNKS
    return found.unionByName(popular.join(F.broadcast(texts) if few else texts, "chunk_id"))


def fetch_chunks(
    hits: DataFrame, chunks: DataFrame, most_hits: int | None = None,
    popular_hits: int = POPULAR_HITS,
) -> DataFrame:
    """Chunk rows of the hits, with rank and distance kept.

    ``most_hits`` is a proven upper bound of the number of hits (questions times k). Up to
    ``BROADCAST_HITS`` the hits travel to the chunks and the big table is not shuffled. Beyond it, or
    without a bound, the stored chunk table (``sources.chunk_store``) is joined in its buckets: the
    hits are shuffled, the texts are not, and the hits of popular chunks get them by broadcast.
    Chunks that are not stored that way are shuffled with the hits on the chunk id.
    """
    if most_hits is not None and most_hits <= BROADCAST_HITS:
        found = chunks.join(F.broadcast(hits), "chunk_id")
    elif BLOCK in chunks.columns:
        found = _from_store(hits, chunks, popular_hits)
    else:
        found = chunks.join(hits, "chunk_id")
    return found.drop(BLOCK)


def contexts(found: DataFrame) -> DataFrame:
    """One context text per question, blocks in rank order. A question has at most k rows."""
    block = X.context_block(
        F.col("class_level"), X.chapter_number(F.col("chapter")), F.col("page_number"),
        F.col("text_content"),
    )
    blocks = F.sort_array(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return found.groupBy("question_id").agg(
        F.array_join(blocks.getField("block"), V.BLOCK_SEPARATOR)
        .alias("context"),
        F.count("*").alias("n_chunks"),
    )


def sources(found: DataFrame, prefix: str, base_dir: str) -> DataFrame:
    """Numbered sources per question; the best-ranked chunk stands for its chapter and page."""
    same_page = Window.partitionBy("question_id", "chapter_no", "page_number").orderBy("rank")
    in_order = Window.partitionBy("question_id").orderBy("rank")
    file = X.document_file(F.col("chapter_no"), prefix)
    return (
        found.select("question_id", "rank", "class_level", "chapter", "page_number")
        .repartition("question_id")  # serves both windows
        .withColumn("chapter_no", X.chapter_number(F.col("chapter")))
        .withColumn("copy", F.row_number().over(same_page))
        .where(F.col("copy") == 1)
        .select(
            "question_id",
            F.row_number().over(in_order).alias("source_no"),
            "class_level",
            F.col("chapter_no").alias("chapter"),
            "page_number",
            X.document_path(file, base_dir).alias("pdf_path"),
            file.alias("pdf_filename"),
            X.source_label(F.col("class_level"), F.col("chapter_no"), F.col("page_number"))
            .alias("label"),
        )
    )


def source_lists(source_rows: DataFrame) -> DataFrame:
    """Nested form of ``sources``: one ordered array of records per question (at most k)."""
    record = F.struct(
        "source_no", "class_level", "chapter", "page_number", "pdf_path", "pdf_filename", "label"
    )
    return source_rows.groupBy("question_id").agg(
        F.transform(
            F.sort_array(F.collect_list(record)), lambda s: s.dropFields("source_no")
        ).alias("sources")
    )


def with_default_context(questions: DataFrame, context_rows: DataFrame) -> DataFrame:
    """All questions; those without a hit get the fixed message and ``found = false``."""
    return questions.join(context_rows, "question_id", "left").select(
        *questions.columns,
        F.coalesce("context", F.lit(V.NO_CONTEXT)).alias("context"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.col("n_chunks").isNotNull().alias("found"),
    )


def answer_prompts(
    questions: DataFrame, model: str, syllabus: str, class_level: int = V.CLASS_LEVEL
) -> DataFrame:
    """Prompt and request per question with context, the ready reply for the others."""
    prompt = X.fill(V.ANSWER_PROMPT, context=F.col("context"), question=F.col("question"))
    reply = X.fill(
        V.NO_CONTEXT_REPLY, class_level=F.lit(class_level), syllabus=F.lit(syllabus)
    )
    return (
        questions.withColumn("prompt", F.when(F.col("found"), prompt))
        .select(
            "question_id",
            "prompt",
            F.when(~F.col("found"), reply).alias("reply"),
            request_payload(F.col("prompt"), model, V.ANSWER_TEMPERATURE).alias("payload"),
        )
    )
