"""Cutting lineage through tables written in the shared checkpoint folder of the cluster.

A written table is computed once (a checkpointed frame is computed twice unless
it is cached as well), keeps its columns separate and gives the optimiser its
real size, which decides between broadcast and shuffle joins downstream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the shared warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def new_folder(spark: SparkSession) -> str:
    """A folder name of its own in the checkpoint folder, removed when the session ends."""
    path = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the checkpoint folder."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
