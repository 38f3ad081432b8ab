"""Live usage counters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.metrics import estimated_students, merged_sketches, student_sketches

TOTAL, STUDENTS = "total_queries", "unique_students"


def start_dashboard(
    log: DataFrame, memory_changes: DataFrame, out_dir: str, checkpoint_dir: str, **trigger
) -> list[StreamingQuery]:
    """Count a stream of log rows, and the users of a stream of memory changes, under ``out_dir``.

    Each batch adds one small row: how many log rows it had, or how many users it saw for the
    first time; the users seen are the state, spread over the state partitions. The row is in
    the batch's own folder, so a replayed batch replaces it. ``trigger`` is as in
    ``writeStream.trigger``; by default all waiting input is processed and the queries end.
    """
    users = memory_changes.select("user_id").where("user_id IS NOT NULL")
    counted = {TOTAL: log.select(F.lit(1).alias("one")), STUDENTS: users.dropDuplicates(["user_id"])}

    def start(metric: str, rows: DataFrame) -> StreamingQuery:
        def write(batch: DataFrame, batch_id: int) -> None:
            folder = f"{out_dir}/metric={metric}/batch_id={batch_id}"
            batch.agg(F.count("*").alias("value")).write.mode("overwrite").parquet(folder)

        return (
            rows.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{checkpoint_dir}/{metric}")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    return [start(metric, rows) for metric, rows in counted.items()]


def read_dashboard(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(metric, value)`` over all batches written so far."""
    written = spark.read.schema("value long, metric string, batch_id long").parquet(out_dir)
    return written.groupBy("metric").agg(F.sum("value").alias("value"))


def start_student_sketches(
    memory_changes: DataFrame, out_dir: str, checkpoint_dir: str, **trigger
) -> StreamingQuery:
    """Keep a distinct-count sketch of the users of every batch and day, under ``out_dir``.

    ``memory_changes`` is ``(user_id, changed_at)``. Unlike the exact counter this has no state that
    grows with the users: a batch adds one small row per day it touches, in its own folder, so a
    replayed batch replaces it. Sketches merge, so any span of days can be counted later.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        days = batch.select(F.to_date("changed_at").alias("day"), "user_id")
        student_sketches(days, ["day"]).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return (
        memory_changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_students(spark: SparkSession, out_dir: str, by: list[str]) -> DataFrame:
    """``by`` and ``students``: about how many distinct users, from all batches written so far.

    ``by`` may be empty (all), or ``["day"]``.
    """
    written = spark.read.schema("day date, sketch binary, batch_id long").parquet(out_dir)
    return estimated_students(merged_sketches(written, by))
