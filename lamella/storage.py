"""Tables that cut lineage, kept in the folder that the cluster shares.

The folder is spark.checkpoint.dir of the session. Only where that is unset on one machine (tests) a
temporary folder is made and set, so that every later call agrees on it; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors can read and write."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lamella/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it again: no lineage, no kept partitioning.

    The result outlives lost executors, and a join above it gets exchanges of its own, which adaptive
    execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release_table(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that materialize() returned."""
    files = df.inputFiles()
    if files:
        release(df.sparkSession, files[0].rpartition("/")[0])
