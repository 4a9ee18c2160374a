"""Cutting lineage where one result feeds several others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which ``spark.checkpoint.dir`` names.

    Where that is unset it is a folder below the session's warehouse, which all executors
    share as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(folder or f"{warehouse}/checkpoints-{uuid.uuid4()}")
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    The copy outlives executors: one that is lost costs nothing that was written.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
