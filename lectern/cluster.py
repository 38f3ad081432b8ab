"""Where a job may put data that every executor must be able to read."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder = ""


def _own_folder() -> str:
    """One temporary folder for the local sessions of this process, removed when it ends."""
    global _local_folder
    if not _local_folder:
        _local_folder = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    # The context is asked only without that setting; a remote session has none.
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_folder()


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: computed exactly once, columns
    that a reader doesn't need aren't read again."""
    path = new_shared_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
