"""Usage counters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dashboard_totals(dashboard_log: DataFrame, memory: DataFrame) -> DataFrame:
    """``(metric, value)``: all logged rows, whatever their name, and distinct students."""
    total = dashboard_log.agg(F.count("*").alias("value"))
    users = memory.agg(F.countDistinct("user_id").alias("value"))
    return total.select(F.lit("total_queries").alias("metric"), "value").unionByName(
        users.select(F.lit("unique_students").alias("metric"), "value")
    )


def queries_by_metric(dashboard_log: DataFrame) -> DataFrame:
    return dashboard_log.groupBy("metric_name").agg(F.count("*").alias("queries"))


# A sketch of 2 ** 14 registers is 16 KB at most; its estimates are off by 0.8 % (one deviation).
SKETCH_REGISTERS = 14
SKETCH_ERROR = 0.03


def student_sketches(rows: DataFrame, by: list[str], user: str = "user_id") -> DataFrame:
    """One distinct-count sketch of the users per group, to be kept and merged instead of the users."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(user, SKETCH_REGISTERS).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups, such as all days of a year or all batches of a stream."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_students(sketches: DataFrame) -> DataFrame:
    """The number of distinct users that each sketch has seen, within about ``SKETCH_ERROR``."""
    return sketches.withColumn("students", F.hll_sketch_estimate("sketch")).drop("sketch")
