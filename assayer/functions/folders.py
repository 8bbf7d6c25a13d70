"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset, a folder under the warehouse serves a session that runs on one
    machine, as in tests; a cluster without the setting is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, so that later reads see the same rows in the same partitions."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint(eager=True)
