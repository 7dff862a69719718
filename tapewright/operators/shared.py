"""Intermediate results in the folder that all executors share, so that lineage ends there and a lost executor costs no rework."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local one in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """The path of a new folder in it."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint, in the same partitions and order.

    Spark knows a checkpoint's partitioning and order only if they are those of the plan as it was made, so the rows are
    written without adaptive execution; it is switched back on right after.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    adaptive = "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(adaptive, before)
