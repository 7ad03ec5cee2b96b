"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it. On a cluster it comes to all machines with
    spark-submit --py-files, or is installed there."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, as in tests, a temporary folder, but only on one machine: a cluster's machines
    don't share such a folder, so there it is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="umbraframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder, under one that goes when the application ends."""
    own = f"{shared_dir(spark)}/umbraframe-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A frame that is used several times, computed once and kept where lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_round(df: DataFrame) -> DataFrame:
    """`stored` for a frame that the next round of a loop joins again. A checkpointed frame keeps the estimated size of the
    plan it came from, and a join's estimate is the product of its sides': after some rounds the numbers alone, with millions
    of digits, would fill the driver. So the rows become a frame without an estimate."""
    spark, rows = df.sparkSession, stored(df)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), rows._jdf.schema(), False), spark)
