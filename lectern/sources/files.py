"""Binary documents as a Spark source."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.cluster import cut_lineage
from lectern.fixed_values import DOCUMENT_SUFFIX

BATCH_PAGES = 5000
# Paths of one read, which Spark lists on the driver, and requests that travel to the contents.
FILES_AT_ONCE = 10_000
BROADCAST_REQUESTS = 500_000
PAGES = "file_name string, page_number int, text string"


def list_documents(
    spark: SparkSession, directory: str, suffix: str = DOCUMENT_SUFFIX
) -> DataFrame:
    """Files directly in ``directory`` with that suffix (case counts), as ``binaryFile`` rows.

    A document may also be a folder ``file_name=<name>`` with one file, as ``write_documents`` makes
    them. Without the ``content`` column no file is opened.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
    )
    if "file_name" in files.columns:
        return files.withColumn("file_name", F.col("file_name").cast("string"))
    return files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def write_documents(lines: DataFrame, order: list[str], directory: str) -> None:
    """Text documents from ``(file_name, line)`` rows, one file each, lines in the given order."""
    (
        lines.repartition("file_name").sortWithinPartitions("file_name", *order)
        .select("file_name", "line").write.partitionBy("file_name").text(directory)
    )


def _literal(path: str) -> str:
    """The path as a pattern that means just itself."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def load_documents(listing: DataFrame, requested: DataFrame) -> DataFrame:
    """Content of every requested ``file_name``; ``loaded`` is false when it is not there.

    The requests are matched with the listing before anything is opened, and only the files they name
    are read, about ``FILES_AT_ONCE`` to a read. The paths pass through the driver, as those of any
    file read do. Up to ``BROADCAST_REQUESTS`` requests go to the contents, which stay where they are
    read; more are shuffled with them.
    """
    names = requested.select("file_name").distinct()
    there = cut_lineage(listing.select("path", "file_name").join(names, "file_name", "left_semi"))
    asking = requested
    if requested.count() <= BROADCAST_REQUESTS:
        asking = F.broadcast(requested)
    missing = requested.join(there.select("file_name"), "file_name", "left_anti")
    answered = missing.withColumn("content", F.lit(None).cast("binary"))
    reads = -(-there.count() // FILES_AT_ONCE)
    for number in range(reads):
        part = there.where(F.pmod(F.xxhash64("path"), F.lit(reads)) == number)
        paths = [_literal(row.path) for row in part.select("path").collect()]
        if paths:
            opened = listing.sparkSession.read.format("binaryFile").load(paths)
            named = opened.select("path", "content").join(F.broadcast(part), "path").drop("path")
            answered = answered.unionByName(named.join(asking, "file_name"))
    return answered.withColumn("loaded", F.col("content").isNotNull())


def extract_pages(
    documents: DataFrame, extractor_factory: Callable[[], Callable[[bytes], Iterator[str]]]
) -> DataFrame:
    """One row per page of ``(file_name, content)``; pages count from 1.

    The extractor, built once per task, yields the page texts of one document, so a long
    document streams out in batches.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor, columns = extractor_factory(), ["file_name", "page_number", "text"]
        for batch in batches:
            rows = []
            for name, content in zip(batch["file_name"], batch["content"]):
                for page_number, text in enumerate(extractor(bytes(content)), start=1):
                    rows.append((name, page_number, text))
                    if len(rows) == BATCH_PAGES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return documents.select("file_name", "content").mapInPandas(extract, PAGES)
