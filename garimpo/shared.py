"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where the setting is absent, a temporary one in local mode and an error on a cluster, whose machines share no such folder."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="garimpo-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set(_SETTING, folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/garimpo-{os.getpid()}"


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has written to the shared folder; results not yet read are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, hint: str) -> str:
    """A new path in the shared folder."""
    return f"{_own(spark)}/{hint}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, hint: str = "t") -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Unlike checkpoint(), the plan runs a single time, and unlike localCheckpoint()
    the result survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, hint)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
