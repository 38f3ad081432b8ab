"""From raw documents to packed training sequences, stage by stage.

Each stage gets what the one before wrote and decides on all of it: language identification rejects
documents, one document of each group of near-duplicates stays, passages that repeat across
documents are cut out, sources are mixed to their weights, and what is left is packed.
"""

from pyspark.sql import DataFrame, SparkSession

from lectern.cluster import new_shared_path
from lectern.llm import stages

STAGES = [
    ("language", stages.known_language),
    ("near_duplicates", stages.one_of_each_group),
    ("repeated_passages", stages.without_repeated_passages),
    ("mix", stages.mixed_sources),
    ("pack", stages.packed_sequences),
]

#: SQL expresses neither trigram models nor tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
