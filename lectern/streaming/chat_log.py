"""Chat pairs as a stream: append logs, session activity and usage metrics."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.sessions import log_rows

COMMITS = "commits"


def start_chat_log(
    pairs: DataFrame, out_dir: str, checkpoint_dir: str, **trigger
) -> StreamingQuery:
    """Write each micro-batch to the tables it changes, under ``out_dir``.

    Every table's rows of a batch go to the folder ``batch_id=<id>`` in overwrite mode, so a
    batch that is replayed after a failure replaces itself. When all its tables are written, a
    row in ``commits`` says so, and only then readers see any of them. ``trigger`` is as in
    ``writeStream.trigger``; by default all waiting input is processed and the query ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marker = f"{out_dir}/{COMMITS}/batch_id={batch_id}"
        done = batch.sparkSession.range(1).select(F.current_timestamp().alias("committed_at"))
        if _exists(batch.sparkSession, marker):  # replayed: not to be seen while it is replaced
            done.limit(0).write.mode("overwrite").parquet(marker)
        batch.persist()
        try:
            for table, rows in log_rows(batch).items():
                rows.write.mode("overwrite").parquet(f"{out_dir}/{table}/batch_id={batch_id}")
        finally:
            batch.unpersist()
        done.write.mode("overwrite").parquet(marker)

    return (
        pairs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.schema("committed_at timestamp").parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def committed_batches(spark: SparkSession, out_dir: str) -> DataFrame:
    """``batch_id`` of every batch whose tables are all written."""
    schema = "committed_at timestamp, batch_id long"
    return spark.read.schema(schema).parquet(f"{out_dir}/{COMMITS}").select("batch_id").distinct()


def read_log(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """A table's rows of the committed batches. A batch is a folder, so others are not read."""
    rows = spark.read.parquet(f"{out_dir}/{table}")
    # One number per batch ever committed.
    done = F.broadcast(committed_batches(spark, out_dir))
    return rows.join(done, "batch_id", "left_semi").drop("batch_id")


def session_activity(spark: SparkSession, out_dir: str) -> DataFrame:
    """Last activity per session over all batches written so far."""
    return read_log(spark, out_dir, "chat_sessions").groupBy("session_id").agg(
        F.max("updated_at").alias("updated_at")
    )
