"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder (tests, a laptop).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where it is unset and all
    tasks run on this machine, else an error: other executors couldn't read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


#: Files for each core that a table of few small rows takes at most.
FILES_A_CORE = 4


def settle(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Compute df once into a table in the shared folder, so that later reads
    neither repeat the work nor depend on an executor that may be lost.  The
    table goes when it is released, or else with the application.

    ``narrow`` is for tables with few columns of numbers: a file for each of
    very many partitions would cost more than what it holds."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism)
    name = f"{checkpoint_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(name)
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(name)
    table._settled = name
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of settle() that no plan still to run will read."""
    for table in tables:
        path, files = _path(table.sparkSession, table._settled)
        files.delete(path, True)
        files.cancelDeleteOnExit(path)
