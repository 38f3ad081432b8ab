"""Small helpers that the operators of this subpackage share."""

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.cluster import new_shared_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The bytes that separate words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are worked on in slices of about this many characters, whatever the batch size is.
SLICE_CHARS = 1_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths of the tables that the steps now being settled have stored, the inner step last.
_steps: list[list[str]] = []
#: A block of a group that is numbered at once has at least so many rows …
LEAST_BLOCK_ROWS = 500
#: … and more when there would be more blocks than this, whose counts one window adds up.
MOST_BLOCKS = 20_000


def stored(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder, by at most ``tasks`` tasks if given, and read back.

    The written table cuts the lineage and survives the loss of executors.
    """
    path = new_shared_path(df.sparkSession, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    if _steps:
        _steps[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(table: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to be computed reads it."""
    _drop(table.sparkSession, [table.stored_at])


def settled(make: Callable[[], DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """What ``make`` gives, written as ``stored`` writes it; the tables stored on the way are dropped.

    Only the result outlives the step, so a long job's disk holds one step at a time. The shuffle
    files of the step go when the driver collects its garbage, which is asked for here.
    """
    _steps.append([])
    try:
        result = make()
        path = new_shared_path(spark, name)
        result.write.parquet(path)
        schema = result.schema
    finally:
        passed = _steps.pop()
    _drop(spark, passed)
    if _steps:
        _steps[-1].append(path)
    del result
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    # Spark's event queues keep hold of the last query, and so of its shuffle files, until another one ends.
    table.isEmpty()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return table


def _drop(spark: SparkSession, paths: list[str]) -> None:
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(settings).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what a task hands to Python at a time, unless the session has its own bound.

    Texts of the default 64 MB a batch, held on both sides, take much of a small executor's memory.
    """
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, "8m")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, for a query that works on texts in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text.

    One text that is longer than a slice is a slice by itself, so nothing is cut.
    """
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    piece = np.cumsum(sizes) // SLICE_CHARS
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in slices of bounded text, each with its texts (null: empty)."""
    for part in sliced(batch, column):
        yield part, [t or "" for t in part.column(column).to_pylist()]


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 … within each group, in an order fixed by ``order``.

    Rows are dealt to blocks of a group by a hash of ``order``; blocks are counted, a window over
    the block counts gives each block its first number, and rows are numbered inside their block.
    A group of any size is thus numbered by many tasks. ``df`` is read twice: store it before.
    """
    sizes = stored(df.groupBy(*group).agg(F.count("*").alias("_rows")), "group-sizes")
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    block = max(LEAST_BLOCK_ROWS, total // MOST_BLOCKS)
    sizes = sizes.select(*group, F.ceil(F.col("_rows") / block).alias("_blocks"))
    spread = F.xxhash64(*order)
    keys = list(group)
    dealt = df.join(sizes, keys).withColumn("_block", F.pmod(spread, F.col("_blocks")))
    counts = stored(dealt.groupBy(*keys, "_block").agg(F.count("*").alias("_rows")), "block-rows")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    first = stored(first, "block-first")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    ranked = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(first, [*keys, "_block"])
        .withColumn(name, F.col("_first") + F.col("_inside"))
        .drop("_block", "_blocks", "_first", "_inside")
    )
