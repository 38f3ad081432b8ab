"""Pages to overlapping chunks with citation metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern import schemas
from lectern.functions import text as X

STEP = V.CHUNK_CHARS - V.OVERLAP_CHARS


# Chunks of so many pages, and so many chunks of a long page, share the first half of their ids.
PAGES_IN_BLOCK, CHUNKS_IN_BLOCK = 16, 64
BLOCK_DIGITS = 16


def chunk_id(document_key: Column, page_number: Column, chunk_no: Column) -> Column:
    """Repeatable id: the same place in the same document always gets the same one.

    It starts with the hash of the block of neighbouring chunks it is in, so the id alone tells
    where a chunk is stored, and a document's chunks lie in few places.
    """
    page_block, chunk_block = F.floor(page_number / PAGES_IN_BLOCK), F.floor(chunk_no / CHUNKS_IN_BLOCK)
    block = F.sha2(F.concat_ws("#", document_key, page_block, chunk_block), 256)
    place = F.sha2(F.concat_ws("#", document_key, page_number, chunk_no), 256)
    return F.concat(F.left(block, F.lit(BLOCK_DIGITS)), F.left(place, F.lit(64 - BLOCK_DIGITS)))


def id_block(chunk_id: Column) -> Column:
    return F.left(chunk_id, F.lit(BLOCK_DIGITS))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Single-line trimmed ``text``; pages without any are dropped."""
    return pages.withColumn("text", X.page_text(F.col("text"))).where(F.length("text") > 0)


def chunk_pages(
    pages: DataFrame, class_level: Column | int = V.CLASS_LEVEL,
    language: Column | str = V.LANGUAGE,
) -> DataFrame:
    """Chunk table from ``(document_key, file_name, page_number, text)``.

    A narrow transformation: windows are made where the page was read, without a shuffle.
    """
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    def window(piece, position):
        following = F.left(F.get("pieces", position + 1), F.lit(V.OVERLAP_CHARS))
        return F.concat(piece, F.coalesce(following, F.lit("")))

    # Cut once from left to right: the time is linear in the text, however long the page.
    steps = F.regexp_extract_all(X.page_text(F.col("text")), F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))
    rows = (
        pages.withColumn("pieces", steps)
        # The inferred filter of a plain posexplode would cut the text again.
        .select(
            *[c for c in pages.columns if c != "text"],
            F.posexplode_outer(F.transform("pieces", window)).alias("chunk_no", "text_content"),
        )
        .where(F.col("chunk_no").isNotNull())
        .select(
            chunk_id(F.col("document_key"), F.col("page_number"), F.col("chunk_no"))
            .alias("chunk_id"),
            as_column(class_level).alias("class_level"),
            as_column(language).alias("language"),
            X.chapter_name(F.col("file_name")).alias("chapter"),
            F.col("page_number"),
            F.col("text_content"),
        )
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.CHUNKS])


def chunk_counts(pages: DataFrame) -> DataFrame:
    """Pages and chunks per chapter, from the text lengths; no chunk is cut for it."""
    return (
        pages.select(
            X.chapter_name(F.col("file_name")).alias("chapter"),
            F.ceil(F.length(X.page_text(F.col("text"))) / STEP).alias("n"),
        )
        .groupBy("chapter")
        .agg(F.count_if(F.col("n") > 0).alias("pages"), F.sum("n").alias("chunks"))
        .where(F.col("pages") > 0)
    )


def citations(pages: DataFrame, prefix: str, base_dir: str) -> DataFrame:
    """Chapter number, file, path and clamped page index of ``requested_page`` per page row."""
    files = pages.groupBy("file_name").agg(F.max("page_number").cast("int").alias("file_pages"))
    chapter = X.chapter_name(F.col("file_name"))
    return (
        pages.join(files, "file_name")
        .withColumn("chapter", chapter)
        .withColumn("chapter_no", X.chapter_number(F.col("chapter")))
        .withColumn("pdf_filename", X.document_file(F.col("chapter_no"), prefix))
        .withColumn("pdf_path", X.document_path(F.col("pdf_filename"), base_dir))
        .withColumn("page_number", F.col("page_number").cast("int"))
        .withColumn(
            "page_index",
            X.page_index(F.col("requested_page").cast("int"), F.col("file_pages")).cast("int"),
        )
    )
