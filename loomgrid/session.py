"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is seen by all."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    A local session without one gets a temporary folder. On a cluster a folder of one machine would lose data with
    that machine, or not be seen by the others, so there a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    return named or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def run_folder(spark: SparkSession) -> str:
    """Where the tables of this application lie in the shared folder, all under its id."""
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def written_table(df: DataFrame) -> DataFrame:
    """The rows written as a compressed table into the run folder and read again: a result that several branches of a plan
    need is made once, and outlives executors. Results are read lazily, so tables stay until ``drop_tables``."""
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> bool:
    """Removes the tables that this application has written; call it when its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
