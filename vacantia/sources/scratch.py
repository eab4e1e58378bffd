"""Shared scratch folder: where lineage is cut and jobs leave files for each other."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it names none, a
    temporary folder of this machine is set in local mode (tests), and a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    current = spark.sparkContext.getCheckpointDir()
    if not path:
        if current:
            return current
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        path = tempfile.mkdtemp(prefix="spark-")
    if not current:
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; later plans start from there."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` computed once, written under ``path`` in place of what is there, and read from it. What Spark
    takes its size for is the size of the files. A checkpoint keeps the estimate of its plan, the
    product of the sizes of all that it joins; in a loop that number gets more digits each round than
    the driver can hold."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
