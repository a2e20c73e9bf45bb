"""The shared folder, and lineage cut by it."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names. Where it is unset, a local folder on a local master, as in tests; a cluster raises."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "fourfold-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from the shared folder, so that a lost executor loses none of it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table that is written once and read again; it goes when the session ends."""
    java = spark._jvm
    path = java.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/fourfold-{name}-{java.java.util.UUID.randomUUID()}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
