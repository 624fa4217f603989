"""Folders that the driver and all executors share, and rows kept there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session of one process may do without, in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="barflow-")
    raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Rows computed once and kept in the shared folder, so a lost executor loses none of them."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()
