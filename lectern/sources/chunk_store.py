"""The stored chunk table, bucketed by id block.

A chunk's id starts with the block of neighbouring chunks it is in (``corpus.chunk_id``), and the table
is bucketed by that block. So an append reads only the ids in the buckets its own blocks hash to, and
a reader with any number of ids joins them where the texts lie: neither moves a stored text.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.cluster import cut_lineage
from lectern.operators.corpus import id_block

BUCKETS = 64
# An append of few blocks names them in its filter, which prunes the buckets. More than twice as many
# blocks as buckets would leave one bucket in seven unread, so they are not named.
MOST_NAMED_BLOCKS = 1000
# Ids are 64 characters; so many of them, as a hash table, stay below 100 MB.
BROADCAST_IDS = 500_000

BLOCK = "id_block"
STORED = T.StructType([*schemas.CHUNKS.fields, T.StructField(BLOCK, T.StringType())])


def create_chunk_table(
    spark: SparkSession, name: str, table_format: str = "parquet", buckets: int = BUCKETS,
    path: str | None = None,
) -> None:
    """An empty chunk table, unless there is one. ``buckets`` is also how many tasks read it in a
    join, so choose it for buckets of some gigabytes."""
    writer = spark.createDataFrame([], STORED).write.format(table_format).mode("ignore")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, BLOCK).saveAsTable(name)


def buckets_of(spark: SparkSession, name: str) -> int:
    told = spark.sql("DESCRIBE EXTENDED IDENTIFIER(:name)", args={"name": name})
    return int(told.where("col_name = 'Num Buckets'").first()["data_type"])


def existing_ids(spark: SparkSession, name: str, blocks: list[str] | None) -> DataFrame:
    """Block and id of the stored chunks, of the named blocks only if there are any named."""
    ids = spark.table(name).select(BLOCK, "chunk_id")
    return ids if blocks is None else ids.where(F.col(BLOCK).isin(blocks))


def _blocks(ids: DataFrame, buckets: int) -> list[str] | None:
    most = min(2 * buckets, MOST_NAMED_BLOCKS)
    found = ids.select(BLOCK).distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted(r[0] for r in found)


def _narrow_copies(batch: DataFrame, name: str) -> DataFrame:
    """Each id of the batch with how often it comes and whether it is stored; no text is read."""
    spark = batch.sparkSession
    copies = batch.groupBy(BLOCK, "chunk_id").agg(F.count("*").alias("copies"))
    if spark.table(name).isEmpty():
        return cut_lineage(copies.withColumn("stored", F.lit(False)))
    blocks = _blocks(batch, buckets_of(spark, name))
    stored = existing_ids(spark, name, blocks).distinct().withColumn("stored", F.lit(True))
    return cut_lineage(
        copies.join(stored, [BLOCK, "chunk_id"], "left").withColumn(
            "stored", F.coalesce("stored", F.lit(False))
        )
    )


def join_by_block(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to ``ids`` (distinct, with their block) on the chunk id, where ``rows`` lie.

    For rows that are laid out by block, as the stored table is: only the block is a join key, and
    inside a block, which is a few chunks, ids are compared. So just the ids travel, and as the
    hashed side, so that no text is sorted.
    """
    ids = ids.withColumnsRenamed({BLOCK: "_block", "chunk_id": "_id"}).hint("shuffle_hash")
    # Not written as equality, which would be a second key that the layout doesn't have.
    same = (rows["chunk_id"] <= ids["_id"]) & (rows["chunk_id"] >= ids["_id"])
    joined = rows.join(ids, (rows[BLOCK] == ids["_block"]) & same, how)
    return joined.drop("_block", "_id")


def _with_ids(batch: DataFrame, wanted: DataFrame, others: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """The rows whose id is in ``wanted``; ``others`` are all other ids. The shorter list travels; if
    both are long, ``batch`` has to be laid out by block."""
    if not counts[1]:
        return batch
    if counts[0] <= BROADCAST_IDS:
        return batch.join(F.broadcast(wanted.select("chunk_id")), "chunk_id", "left_semi")
    if counts[1] <= BROADCAST_IDS:
        return batch.join(F.broadcast(others.select("chunk_id")), "chunk_id", "left_anti")
    return join_by_block(batch, wanted, "left_semi")


def _laid_out(rows: DataFrame, buckets: int) -> DataFrame:
    """One task, and so one file, for each bucket that gets something. Rows that lie so already stay."""
    return rows.repartition(buckets, BLOCK)


def new_chunks(batch: DataFrame, existing_name: str) -> DataFrame:
    """Rows of ``batch`` (with ``id_block``) whose id is not stored yet, one of each id.

    ``batch`` is read several times, mostly without its texts: store it before. Where texts have to be
    moved, they are laid out in the buckets of the stored table, so that a write moves them no more.
    """
    found = _narrow_copies(batch, existing_name)
    told = found.agg(
        F.count_if(~F.col("stored")).alias("new"), F.count_if("stored").alias("old"),
        F.max("copies").alias("copies"),
    ).first()
    missing, present = (found.where(c).select(BLOCK, "chunk_id") for c in ("NOT stored", "stored"))
    counts, buckets = (told["new"], told["old"]), buckets_of(batch.sparkSession, existing_name)
    if min(counts) > BROADCAST_IDS:
        batch, missing = _laid_out(batch, buckets), _laid_out(missing, buckets)
    rows = _with_ids(batch, missing, present, counts)
    if (told["copies"] or 0) <= 1:
        return rows
    # The block is part of the id; with it, copies are found where they are laid out.
    return _laid_out(rows, buckets).dropDuplicates([BLOCK, "chunk_id"])


def append_chunks(chunks: DataFrame, name: str) -> DataFrame:
    """Append the chunks that are not there yet and return them; running it again adds nothing.

    The batch is written to the shared folder once, so documents are extracted once, whatever is
    then asked of it. A batch that names a chunk twice adds it once.
    """
    kept: list[Column] = [F.col(f.name).cast(f.dataType) for f in schemas.CHUNKS]
    batch = cut_lineage(chunks.select(*kept, id_block(F.col("chunk_id")).alias(BLOCK)))
    added = new_chunks(batch, name)  # from written tables only, so it stays what it is
    laid_out = _laid_out(added, buckets_of(chunks.sparkSession, name))
    laid_out.select(*STORED.fieldNames()).write.mode("append").insertInto(name)
    return added.drop(BLOCK)
