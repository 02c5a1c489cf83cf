"""What the driver and all executors share: the folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one machine takes a temporary one, and a cluster is refused."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="segloom-"))
    return named or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    shared_path(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession) -> str:
    """A new folder's path below the shared one; what is written there goes when the application ends."""
    path = f"{shared_path(spark)}/segloom-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
