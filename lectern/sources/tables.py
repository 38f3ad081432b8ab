"""Reading, creating, appending to and resetting the persisted tables."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.cluster import cut_lineage
from lectern.sources import chunk_store


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in table order and type; ``timestamp`` columns not given are stamped now."""
    now = F.current_timestamp()
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns or f.dataType != T.TimestampType() else now)
            .cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def create_tables(
    spark: SparkSession, database: str, table_format: str = "parquet",
    buckets: int = chunk_store.BUCKETS,
) -> None:
    """Create every table that does not exist yet; ``buckets`` is for the chunk table."""
    chunk_store.create_chunk_table(spark, f"{database}.corpus_chunks", table_format, buckets)
    for name, schema in {"corpus_vectors": schemas.VECTORS, **schemas.DYNAMIC_TABLES}.items():
        empty = spark.createDataFrame([], schema)
        empty.write.format(table_format).mode("ignore").saveAsTable(f"{database}.{name}")


def append(rows: DataFrame, database: str, name: str) -> None:
    schema = {"corpus_vectors": schemas.VECTORS, **schemas.DYNAMIC_TABLES}[name]
    conform(rows, schema).write.mode("append").insertInto(f"{database}.{name}")


def replace(rows: DataFrame, database: str, name: str) -> None:
    """Put ``rows`` in place of the table, also when they were computed from it.

    The new state is complete in the shared folder before the table is touched.
    """
    state = cut_lineage(conform(rows, schemas.DYNAMIC_TABLES[name]))
    state.write.insertInto(f"{database}.{name}", overwrite=True)


def append_chunks(chunks: DataFrame, database: str) -> DataFrame:
    """Append the chunks that are not there yet and return them; running it again adds nothing."""
    return chunk_store.append_chunks(chunks, f"{database}.corpus_chunks")


def reset_dynamic_tables(spark: SparkSession, database: str) -> None:
    """Empty all tables filled by use; the corpus stays."""
    for name in schemas.DYNAMIC_TABLES:
        spark.sql(
            "TRUNCATE TABLE IDENTIFIER(:table_name)", args={"table_name": f"{database}.{name}"}
        )


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Persist ``(chunk_id, embedding)``; the id travels with its vector."""
    conform(vectors, schemas.VECTORS).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VECTORS).parquet(path)
