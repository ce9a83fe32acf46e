"""Cut points of iterative plans, in the folder that the cluster shares, and how rows are dealt over tasks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session uses a folder of its own, and a cluster, whose machines reach none in common, raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="shapeloom-checkpoints-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name (as a URI) under the shared folder."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table of an iteration to the shared folder and go on from there."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by) -> DataFrame:
    """Rows dealt over all cores before costly work on each, however few files they come from; those with equal ``by`` meet in one task, next to each other."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by).sortWithinPartitions(*by) if by else df.repartition(tasks)
