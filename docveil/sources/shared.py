"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in local mode a temporary one where none is set, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jsc = spark.sparkContext._jsc.sc()
        d = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docveil-"))
        return shared_dir(spark)  # below the temporary folder, as Spark names it
    return d


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new empty folder in the shared one, which Hadoop deletes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/docveil/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: it cuts the lineage and survives lost executors.

    Hadoop deletes the table when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docveil/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
